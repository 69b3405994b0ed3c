"""Regressions on multiply imputed tables, pooled by Rubin's rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing
from .checks import missing_counts
from .imputers import MiceImputer, MultipleImputer
from .regression import Design, Linear, design, irls, linear_fits


def rubin(betas: np.ndarray, variances: np.ndarray, dfcom: float = np.inf) -> dict[str, np.ndarray]:
    """Pooled estimates of m fits: within (vw), between (vb) and total variance (vt), standard errors, lambda, and what follows from it.

    dfadj are Barnard and Rubin's degrees of freedom, dfcom those of the
    complete table; riv is the relative increase in variance, fmi the fraction
    of missing information and eff the efficiency relative to infinitely many
    imputations. lambda counts as 1e-4 at least for dfadj, and so does fmi for eff.
    """
    m = len(betas)
    mean, vw = betas.mean(axis=0), variances.mean(axis=0)
    vb = betas.var(axis=0, ddof=1) if m > 1 else np.zeros_like(mean)
    more = vb * (1 + 1 / m)
    vt = vw + more
    lam = np.divide(more, vt, out=np.zeros_like(vt), where=vt > 0)
    riv = np.divide(more, vw, out=np.where(more > 0, np.inf, 0.0), where=vw > 0)
    floor = np.maximum(lam, 1e-4)
    old = (m - 1) / floor**2
    if np.isinf(dfcom):
        dfadj = old
    else:
        seen = (dfcom + 1) / (dfcom + 3) * dfcom * (1 - floor)
        dfadj = np.divide(old * seen, old + seen, out=np.zeros_like(old), where=old + seen > 0)
    fmi = (dfadj + 1) / (dfadj + 3) * lam + 2 / (dfadj + 3)
    eff = 1 / (1 + np.maximum(fmi, 1e-4) / m)
    return {"coefs": mean, "vw": vw, "vb": vb, "vt": vt, "std": np.sqrt(vt), "dfcom": np.full_like(vt, dfcom), "dfadj": dfadj, "lambda_": lam, "riv": riv, "fmi": fmi, "eff": eff}


def _same_length(q_bar, q) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.atleast_1d(np.asarray(q_bar, float)), np.atleast_1d(np.asarray(q, float))
    if a.shape != b.shape:
        raise ValueError("estimates and true values differ in number")
    return a, b


def raw_bias(q_bar, q) -> np.ndarray:
    """Estimates less the true values."""
    a, b = _same_length(q_bar, q)
    return a - b


def percent_bias(q_bar, q) -> np.ndarray:
    """The size of the bias in percent of the true values, with their sign."""
    a, b = _same_length(q_bar, q)
    return 100 * np.abs(a - b) / b


class _Pooled:
    """What pooled regressions share: the imputer, terms, summary, and the guard of predictions.

    imputer: a chained one with ``mi_kwgs``, unless given. ``variances=False``
    pools coefficients alone, as of models without standard errors.
    """

    design_: Design

    def __init__(self, imputer=None, variances: bool = True, mi_kwgs: dict | None = None, model_kwgs: dict | None = None):
        if imputer is not None and mi_kwgs:
            raise ValueError("mi_kwgs are for the default imputer")
        if imputer is not None and not isinstance(imputer, MultipleImputer):
            raise TypeError(f"a multiple or chained imputer is needed, not {type(imputer).__name__}")
        self.imputer = MiceImputer(**(mi_kwgs or {})) if imputer is None else imputer
        self.variances, self.model_kwgs = variances, dict(model_kwgs or {})

    def _pool(self, plan: Design, betas: list[np.ndarray], variances: list[np.ndarray], dfcom: float) -> None:
        self.design_ = plan
        self.statistics_ = rubin(np.array(betas), np.array(variances), dfcom) if self.variances else {"coefs": np.array(betas).mean(axis=0)}
        self.terms_ = ["const", *[c if v is None else f"{c}_{v}" for c, v in plan.terms]]

    def summary(self, spark) -> DataFrame:
        self._fitted()
        s = self.statistics_
        names = ("coefs", "std", "vw", "vb", "vt", "dfcom", "dfadj", "lambda_", "riv", "fmi", "eff") if self.variances else ("coefs",)
        rows = [(t, *[float(s[k][i]) for k in names]) for i, t in enumerate(self.terms_)]
        return spark.createDataFrame(rows, "term string, " + ", ".join(f"{k.rstrip('_')} double" for k in names))

    def _fitted(self) -> None:
        if not hasattr(self, "statistics_"):
            raise ValueError("fit comes first")

    def _score(self, df: DataFrame) -> Column:
        """The pooled linear predictor; absent predictors and missing cells in them are errors."""
        self._fitted()
        names = sorted({c for c, _ in self.design_.terms})
        lost = set(names) - set(df.columns)
        if lost:
            raise ValueError(f"predictors are absent: {sorted(lost)}")
        gaps = {c: n for c, n in missing_counts(df.select(*[f"`{c}`" for c in names])).items() if c and n}
        if gaps:
            raise ValueError(f"predictors have missing cells: {gaps}")
        beta = self.statistics_["coefs"]
        return Linear(self.design_, beta, np.zeros((len(beta),) * 2), 0.0, 0).predict(df)


class MiLinearRegression(_Pooled):
    """Least squares on each imputed table; two aggregates, grouped by imp_num, serve all fits."""

    def fit(self, df: DataFrame, target: str, names: list[str]) -> MiLinearRegression:
        fits = linear_fits(self.imputer.fit(df).transform(df), target, names, by="imp_num")
        self.models_: list[Linear] = [fits[g] for g in sorted(fits)]
        var = [np.diag(m.cov) * m.mse * m.n / max(1, m.n - len(m.beta)) for m in self.models_]
        first = self.models_[0]
        self._pool(first.design, [m.beta for m in self.models_], var, first.n - len(first.beta))
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self._score(df))


class MiLogisticRegression(_Pooled):
    """Logistic regression on each imputed table; a step of all fits is one aggregate, grouped by imp_num. model_kwgs: ridge, rounds, tol."""

    def fit(self, df: DataFrame, target: str, names: list[str]) -> MiLogisticRegression:
        long = self.imputer.fit(df).transform(df)
        full = long.where(~is_missing(long, target))
        for c in names:
            full = full.where(~is_missing(long, c))
        self.levels_ = [r[0] for r in full.select(target).distinct().orderBy(target).limit(3).collect()]
        if len(self.levels_) != 2:
            raise ValueError(f"{target} needs two values")
        plan = design(df, names)
        cols = plan.columns(full)
        y = (F.col(f"`{target}`") == F.lit(self.levels_[1])).cast("double")
        flat = full.select(F.col("imp_num").alias("g"), y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)]).persist()
        try:
            fits = irls(flat, len(cols), list(range(1, self.imputer.getOrDefault("n") + 1)), **self.model_kwgs)
        finally:
            flat.unpersist()
        done = [fits[g] for g in sorted(fits)]
        self._pool(plan, [b for b, _, _ in done], [np.diag(c) for _, c, _ in done], done[0][2] - len(cols))
        return self

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """The chance of the larger value of the target."""
        return df.withColumn(name, 1 / (1 + F.exp(-self._score(df))))

    def predict(self, df: DataFrame, threshold: float = 0.5, name: str = "prediction") -> DataFrame:
        p = 1 / (1 + F.exp(-self._score(df)))
        return df.withColumn(name, F.when(p >= threshold, F.lit(self.levels_[1])).otherwise(F.lit(self.levels_[0])))
