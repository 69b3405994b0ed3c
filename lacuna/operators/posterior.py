"""Draws from the posterior of a linear regression, from its sufficient statistics alone.

y = alpha + x'beta + e with e ~ N(0, sigma^2); alpha ~ N(am, asd^2), each beta ~
N(bm, bsd^2), sigma ~ half-Cauchy(sig). A Gibbs sampler takes the coefficients
given sigma (normal), sigma^2 given the coefficients (inverse gamma), and the
scale that mixes inverse gammas to a half-Cauchy. No step reads data: one draw
costs a k by k solution, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PRIORS = ("am", "asd", "bm", "bsd", "sig")


@dataclass(frozen=True)
class Sums:
    """n rows, the means of x and y, and the sums of products about these means, y last."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @property
    def xx(self) -> np.ndarray:
        return self.products[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.products[:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.products[-1, -1])


@dataclass(frozen=True)
class Posterior:
    """Draws of (alpha, beta) in rows, of sigma, and the mean of the conditional means, which varies less than that of the draws."""

    coefs: np.ndarray
    sigma: np.ndarray
    mean: np.ndarray

    def draw(self, rng: np.random.Generator, joint: bool = True) -> np.ndarray:
        """One draw of the coefficients; unless ``joint``, alpha is a draw by itself and beta a normal with the draws' mean and covariance."""
        one = self.coefs[rng.integers(len(self.coefs))]
        if joint or len(one) == 1:
            return one
        beta = self.coefs[:, 1:]
        cov = np.atleast_2d(np.cov(beta.T))
        return np.concatenate([one[:1], rng.multivariate_normal(beta.mean(axis=0), cov, method="eigh")])


def gibbs(sums: Sums, am: float = 0.0, asd: float = 10.0, bm: float | np.ndarray = 0.0, bsd: float = 10.0, sig: float = 1.0, sample: int = 1000, tune: int = 1000, seed: int = 0) -> Posterior:
    """``sample`` draws after ``tune`` others. Infinite asd or bsd is a flat prior."""
    if asd <= 0 or bsd <= 0 or sig <= 0 or sample < 1 or tune < 0:
        raise ValueError("scales of priors and the number of draws are above 0")
    k = len(sums.xy)
    rng = np.random.default_rng(seed)
    # coordinates in which the data's part is well conditioned: intercept at the means of x, slopes of x in units of its spread
    spread = np.sqrt(np.where(np.diag(sums.xx) > 0, np.diag(sums.xx) / max(1, sums.n), 1.0))
    back = np.zeros((k + 1, k + 1))
    back[0, 0], back[0, 1:] = 1.0, -sums.mean[:-1] / spread
    back[1:, 1:] = np.diag(1 / spread)
    info = np.zeros((k + 1, k + 1))
    info[0, 0], info[1:, 1:] = sums.n, sums.xx / np.outer(spread, spread)
    data = np.concatenate([[sums.n * sums.mean[-1]], sums.xy / spread])
    precision = np.diag(np.concatenate([[1 / asd**2], np.full(k, 1 / bsd**2)]))
    centre = np.concatenate([[am], np.broadcast_to(np.asarray(bm, float), (k,))])
    prior, pull = back.T @ precision @ back, back.T @ precision @ centre
    total = sums.yy + sums.n * sums.mean[-1] ** 2

    def squares(t: np.ndarray) -> float:
        gap = sums.mean[-1] - t[0]
        slopes = t[1:]
        return max(0.0, sums.n * gap * gap + sums.yy - 2 * slopes @ (sums.xy / spread) + slopes @ info[1:, 1:] @ slopes)

    variance = max(sums.yy / max(1, sums.n), 1e-12 * max(1.0, total))
    draws, sigmas, means = np.empty((sample, k + 1)), np.empty(sample), np.zeros(k + 1)
    for i in range(-tune, sample):
        values, vectors = np.linalg.eigh(info / variance + prior)
        # a direction that neither data nor prior tell about stays at zero
        known = values > values[-1] * 1e-13
        inverse = np.where(known, 1 / np.where(known, values, 1.0), 0.0)
        mean = vectors @ (inverse * (vectors.T @ (data / variance + pull)))
        theta = mean + vectors @ (np.sqrt(inverse) * rng.standard_normal(k + 1))
        mixed = 1 / rng.gamma(1.0, 1 / (1 / sig**2 + 1 / variance))
        variance = max((squares(theta) / 2 + 1 / mixed) / rng.gamma((sums.n + 1) / 2), 1e-300)
        if i >= 0:
            draws[i], sigmas[i] = back @ theta, variance**0.5
            means += back @ mean / sample
    return Posterior(draws, sigmas, means)
