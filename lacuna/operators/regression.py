"""Regression strategies: one aggregate gives X'X and X'y; the solution becomes literals of a Column.

``fit`` returns what a strategy learned as plain numbers and, for donors, a
table; ``apply`` fills with it. Both take ``by``: a column with a small number of
groups (imputations of one table, say), each of which has a fit of its own; all
fits come from the same aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import by_group, digest, is_missing, is_numeric, normal, observed, uniform
from .posterior import PRIORS, Sums, gibbs

STRATEGIES = ("least squares", "stochastic", "bayesian least squares", "pmm", "lrd", "binary logistic", "bayesian binary logistic", "multinomial logistic", "default predictive")
#: A string of at most so many levels becomes 0/1 columns, one for each level but the smallest; one of more levels a 0/1 column for each of BUCKETS hash buckets but the first.
LEVELS = 256
BUCKETS = 64
#: Columns of X beyond which sums of products are taken by matrix products instead of SQL sums, and partial sums that reach the driver then.
WIDE = 24
PARTS = 32

Level = str | int | None


def usable(df: DataFrame, names: list[str]) -> list[str]:
    """The names whose columns can be predictors: numbers, booleans and strings; dates, times and nested types are left out."""
    return [c for c in names if is_numeric(df, c) or isinstance(df.schema[c].dataType, T.StringType)]


def _bucket(x: Column) -> Column:
    return F.pmod(digest(x), F.lit(BUCKETS)).cast("int")


def flags(levels: list[str | int], cell: Column) -> Column:
    """An array with a 0/1 for each level."""
    held = F.from_json(F.lit(json.dumps(levels)), "array<int>" if isinstance(levels[0], int) else "array<string>")
    return F.transform(held, lambda v: (v == cell).cast("double"))


@dataclass(frozen=True)
class Design:
    """Columns of X by name: a numeric column, or (column, level) for a string's levels but the smallest, or (column, number) for its hash buckets but the first.

    ``fills`` has what missing cells count as, for each group; a bucket's number for strings by bucket.
    """

    terms: tuple[tuple[str, Level], ...]
    fills: dict[str, dict[Any, float | str | int]]

    def cells(self, df: DataFrame, by: str | None = None) -> dict[str, Column]:
        """Each predictor's number, string or hash bucket, with fills where missing."""
        out = {}
        for c, level in dict(self.terms).items():
            x = observed(df, c)
            x = F.when(~is_missing(df, c), _bucket(x)) if isinstance(level, int) else x
            out[c] = F.coalesce(x, by_group(self.fills[c], by)) if self.fills.get(c) else x
        return out

    def levels(self) -> dict[str, list[Level]]:
        """The levels of each predictor, [None] for a number, in the order of the terms."""
        out: dict[str, list[Level]] = {}
        for c, level in self.terms:
            out.setdefault(c, []).append(level)
        return out

    def columns(self, df: DataFrame, by: str | None = None) -> list[Column]:
        cells = self.cells(df, by)
        return [F.lit(1.0), *[cells[c].cast("double") if level is None else (cells[c] == level).cast("double") for c, level in self.terms]]

    def array(self, df: DataFrame, by: str | None = None) -> Column:
        """The columns but the first, as one array: a predictor's cell is read once, whatever its levels."""
        cells, parts = self.cells(df, by), []
        for c, own in self.levels().items():
            parts.append(F.array(cells[c].cast("double")) if own == [None] else flags(own, cells[c]))
        return F.concat(*parts) if parts else F.array().cast("array<double>")

    def dot(self, df: DataFrame, betas: dict[Any, list[float]], by: str | None = None) -> Column:
        """The linear predictor of each group; a string's coefficient is looked up by its level."""
        cells, at = self.cells(df, by), 1
        total = by_group({g: float(b[0]) for g, b in betas.items()}, by)
        for c, own in self.levels().items():
            if own == [None]:
                total = total + by_group({g: float(b[at]) for g, b in betas.items()}, by) * cells[c].cast("double")
            else:
                held = {f"{g}|{v}": float(b[at + i]) for g, b in betas.items() for i, v in enumerate(own)}
                key = F.concat_ws("|", F.col(f"`{by}`").cast("string") if by else F.lit("None"), cells[c].cast("string"))
                total = total + F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(held)), "map<string,double>"), key), F.when(cells[c].isNotNull(), 0.0))
            at += len(own)
        return total

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(c for c, _ in self.terms))


def design(df: DataFrame, names: list[str], fill: bool = True) -> Design:
    """The columns of X; with ``fill``, missing cells count as the column's mean, or its most frequent string."""
    names, terms = usable(df, names), []
    for c in names:
        if is_numeric(df, c):
            terms.append((c, None))
            continue
        levels = [r[0] for r in df.select(observed(df, c).alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(LEVELS + 1).collect()]
        terms += [(c, v) for v in (levels[1:] if len(levels) <= LEVELS else range(1, BUCKETS))]
    plan = Design(tuple(terms), {})
    return replace(plan, fills=fills(df, plan)) if fill else plan


def fills(df: DataFrame, plan: Design, by: str | None = None) -> dict[str, dict[Any, float | str | int]]:
    """What a missing cell of each predictor counts as, by group: the mean, or the most frequent value (the smallest of such), among the rows of df; 0 where none is observed.

    One aggregate; predictors without a missing cell need nothing.
    """
    if not plan.terms:
        return {}
    kinds = dict(plan.terms)
    cells = []
    for c in plan.names:
        x = observed(df, c)
        typical = F.avg(x.cast("double")) if kinds[c] is None else F.mode(F.when(~is_missing(df, c), _bucket(x)) if isinstance(kinds[c], int) else x, True)
        cells.append(F.struct(F.count_if(is_missing(df, c)).alias("gone"), typical.alias("v")))
    rows = df.groupBy(*([f"`{by}`"] if by else [])).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).collect()
    out = {}
    for i, c in enumerate(plan.names):
        none = 0.0 if kinds[c] is None else 0 if isinstance(kinds[c], int) else ""
        if any(r[f"c{i}"]["gone"] for r in rows):
            out[c] = {(r[by] if by else None): (none if r[f"c{i}"]["v"] is None else r[f"c{i}"]["v"]) for r in rows}
    return out


@dataclass(frozen=True)
class Linear:
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    mse: float
    n: int
    sums: Sums | None = None

    def predict(self, df: DataFrame, beta: np.ndarray | None = None) -> Column:
        return self.design.dot(df, {None: self.beta if beta is None else beta})


def _sql_sums(rows: DataFrame, mids: dict[str, tuple[int, np.ndarray]], by: bool) -> dict[str, dict[Any, np.ndarray]]:
    """Sums of products of (1, x - mid) for each target, whose columns begin at a number, and group; one aggregate."""
    sums, spans = [], {}
    for c, (a, mid) in mids.items():
        dev = [F.when(F.col(f"x{a}").isNotNull(), 1.0), *[F.col(f"x{a + i}") - float(m) for i, m in enumerate(mid)]]
        first = len(sums)
        sums += [F.sum(dev[i] * dev[j]) for i in range(len(dev)) for j in range(i, len(dev))]
        spans[c] = (first, len(sums), len(dev))
    out: dict[str, dict[Any, np.ndarray]] = {c: {} for c in mids}
    for r in rows.groupBy(*(["g"] if by else [])).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
        for c, (first, last, k) in spans.items():
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = [v or 0.0 for v in r[first + by : last + by]]
            out[c][r["g"] if by else None] = m + np.triu(m, 1).T
    return out


def _wide_sums(rows: DataFrame, k: int, mid: np.ndarray | None, by: bool) -> dict[Any, np.ndarray]:
    """Sums of products of (1, x - mid) from an array column x of k numbers, by matrix products; without ``mid`` sums of (1, x).

    A partition adds up its own, PARTS tasks add up those of partitions.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, k)
            x = np.column_stack([np.ones(len(x)), x if mid is None else x - mid])
            g = np.array(batch.column(0).to_pylist(), object)
            for v in set(g):
                part = x[g == v]
                held[v] = held.get(v, 0.0) + (part.sum(axis=0) if mid is None else part.T @ part)
        yield from _packed(held)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[g] = held.get(g, 0.0) + np.frombuffer(s)
        yield from _packed(held)

    schema = "g string, s binary"
    cells = rows.select((F.col("g").cast("string") if by else F.lit("")).alias("g"), "x")
    parts = cells.mapInArrow(own, schema).repartition(PARTS).mapInArrow(several, schema).collect()
    kind = int if by and rows.schema["g"].dataType.typeName() in ("integer", "long") else str
    out: dict[Any, np.ndarray] = {}
    for r in parts:
        g = kind(r.g) if by else None
        out[g] = out.get(g, 0.0) + np.frombuffer(r.s)
    return out if mid is None else {g: v.reshape(k + 1, k + 1) for g, v in out.items()}


def _packed(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array([np.asarray(v).tobytes() for v in held.values()], pa.binary())], ["g", "s"])


def many_fits(df: DataFrame, targets: dict[str, list[str]], by: str | None = None, plans: dict[str, Design] | None = None, where: dict[str, Column] | None = None) -> dict[str, dict[Any, Linear]]:
    """Least squares of several targets for each group, each on its rows in which target and predictors are observed (and ``where`` holds).

    Two aggregates for all targets and groups: means, then sums of products about
    them. A cell that doesn't count for a target is null there, and sums skip it.
    """
    plans = {c: replace(plans[c], fills={}) if plans and c in plans else design(df, names, fill=False) for c, names in targets.items()}
    group = [F.col(f"`{by}`").alias("g")] if by else []
    spans, flat, out = {}, [], {}
    for c, plan in plans.items():
        full = ~is_missing(df, c) & (where or {}).get(c, F.lit(True))
        for x in usable(df, targets[c]):
            full = full & ~is_missing(df, x)
        y = F.col(f"`{c}`").cast("double")
        if (k := len(plan.terms) + 1) > WIDE:
            rows = df.where(full).select(*group, F.concat(plan.array(df), F.array(y)).alias("x"))
            first = _wide_sums(rows, k, None, by is not None)
            total = sum(first.values(), np.zeros(k + 1))
            if not total[0]:
                raise ValueError(f"no complete row to fit {c}")
            mid = total[1:] / total[0]
            out[c] = {g: _solved(plan, mid, m) for g, m in _wide_sums(rows, k, mid, by is not None).items()}
            continue
        cols = [*plan.columns(df)[1:], y]
        spans[c] = (len(flat), len(flat) + len(cols))
        flat += [F.when(full, x) for x in cols]
    if not spans:
        return out
    rows = df.select(*group, *[x.alias(f"x{i}") for i, x in enumerate(flat)])
    # centred sums keep X'X well conditioned; means over all groups are near those of each
    mean = rows.agg(*[F.avg(f"x{i}") for i in range(len(flat))]).first()
    for c, (_, b) in spans.items():
        if mean[b - 1] is None:
            raise ValueError(f"no complete row to fit {c}")
    mids = {c: (a, np.array(mean[a:b], float)) for c, (a, b) in spans.items()}
    for c, by_g in _sql_sums(rows, mids, by is not None).items():
        out[c] = {g: _solved(plans[c], mids[c][1], m) for g, m in by_g.items() if m[0, 0]}
    return out


def linear_fits(df: DataFrame, target: str, names: list[str], by: str | None = None, plan: Design | None = None) -> dict[Any, Linear]:
    """``many_fits`` of one target."""
    return many_fits(df, {target: names}, by, {target: plan} if plan else None)[target]


def _solved(plan: Design, mid: np.ndarray, m: np.ndarray) -> Linear:
    """From the sums of products of (1, x - mid, y - mid)."""
    n, off = float(m[0, 0]), m[0, 1:] / m[0, 0]
    products = m[1:, 1:] - n * np.outer(off, off)
    mean = mid + off
    xtx, xty = products[:-1, :-1], products[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
    inverse = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale) if len(xty) else np.zeros((0, 0))
    slopes = inverse @ xty
    sse = max(0.0, float(products[-1, -1] - slopes @ xty))
    beta = np.concatenate([[mean[-1] - slopes @ mean[:-1]], slopes])
    cov = np.zeros((len(beta), len(beta)))
    cov[1:, 1:] = inverse
    cov[0, 1:] = cov[1:, 0] = -inverse @ mean[:-1]
    cov[0, 0] = 1 / n + mean[:-1] @ inverse @ mean[:-1]
    return Linear(plan, beta, cov, sse / n, int(n), Sums(int(n), mean, products))


def least_squares(df: DataFrame, target: str, names: list[str]) -> Linear:
    """On rows in which the target and all predictors are observed."""
    return linear_fits(df, target, names)[None]


def irls(flat: DataFrame, k: int, groups: list[int], ridge: float = 0.0, rounds: int = 50, tol: float = 1e-9, at: float = 0.0, ridge_0: float = 0.0, at_0: float = 0.0) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Logistic regressions of y (0 or 1) on x0 (all 1) to x<k - 1>, one for each value of ``g``: coefficients, covariance, rows.

    Newton's steps; each is one aggregate over the table for all groups at
    once, and only k * k sums of each group reach the driver. ``ridge`` is the
    precision of a normal prior of the standardised slopes, about ``at``, ridge_0
    and at_0 those of the intercept at the means. Without them, classes
    that a plane separates have no finite solution; steps end after ``rounds``.
    """
    first = flat.agg(*[F.avg(f"x{i}") for i in range(1, k)], *[F.stddev_pop(f"x{i}") for i in range(1, k)], F.count(F.lit(1))).first()
    if not first[-1]:
        raise ValueError("no complete row to fit")
    mid, sd = np.array(first[: k - 1], float), np.array([v or 1.0 for v in first[k - 1 : 2 * k - 2]], float)
    x = [F.lit(1.0), *[(F.col(f"x{i}") - float(mid[i - 1])) / float(sd[i - 1]) for i in range(1, k)]]
    beta = {g: np.zeros(k) for g in groups}
    prior, centre = np.diag([ridge_0, *[ridge] * (k - 1)]), np.array([at_0, *[at] * (k - 1)])
    upper = np.triu_indices(k)
    for _ in range(rounds):
        eta = F.lit(0.0)
        for i in range(k):
            at = F.create_map(*[F.lit(v) for g in groups for v in (g, float(beta[g][i]))])
            eta = eta + F.element_at(at, F.col("g")) * x[i]
        known = flat.select("g", "y", *[c.alias(f"z{i}") for i, c in enumerate(x)], (1 / (1 + F.exp(-eta))).alias("p"))
        w = F.col("p") * (1 - F.col("p"))
        sums = known.groupBy("g").agg(F.count(F.lit(1)), *[F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")) for i in range(k)], *[F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in zip(*upper)])
        out, far = {}, 0.0
        for r in sums.collect():
            h = np.zeros((k, k))
            h[upper] = r[2 + k :]
            inverse = np.linalg.pinv(h + np.triu(h, 1).T + prior, rcond=1e-12, hermitian=True)
            step = inverse @ (np.array(r[2 : 2 + k], float) - prior @ (beta[r[0]] - centre))
            out[r[0]] = (beta[r[0]], inverse, r[1])
            beta[r[0]] = beta[r[0]] + step
            far = max(far, float(np.abs(step).max()))
        if far < tol:
            break
    back = np.diag([1.0, *(1 / sd)])
    back[0, 1:] = -mid / sd
    return {g: (back @ beta[g], back @ cov @ back.T, n) for g, (_, cov, n) in out.items()}


def draw(model: Linear, seed: int) -> np.ndarray:
    """A draw of the coefficients from their posterior under flat priors."""
    rng = np.random.default_rng(seed)
    free = max(1, model.n - len(model.beta))
    sigma2 = model.mse * model.n / rng.chisquare(free)
    return rng.multivariate_normal(model.beta, model.cov * sigma2, method="eigh")


def pool(df: DataFrame, target: str, hat: Column, names: list[str], key: list[str], by: str | None = None) -> DataFrame:
    """The donors of a table: its complete rows' predictions, values and a hash of their key."""
    full = df.withColumn("__hat", hat).where(~is_missing(df, target))
    for c in names:
        full = full.where(~is_missing(df, c))
    return full.select(*([F.col(f"`{by}`").alias("__g")] if by else [F.lit(0).alias("__g")]), "__hat", F.col(f"`{target}`").cast("double").alias("__y"), F.xxhash64(*[f"`{c}`" for c in key]).alias("__h"))


def donors(df: DataFrame, target: str, model: Linear, beta: np.ndarray, key: list[str], seed: int, k: int = 5, shift: bool = False, fill_value: str = "random") -> DataFrame:
    """Predictive mean matching within one table: fitted coefficients for donors, ``beta`` for missing cells."""
    plan = replace(model, design=replace(model.design, fills=fills(df.where(is_missing(df, target)), model.design)))
    return matched(df, target, plan.predict(df, beta), pool(df, target, model.predict(df), model.design.names, key), key, seed, k, "classic" if shift else None, fill_value)


def matched(df: DataFrame, target: str, hat: Column, pool: DataFrame, key: list[str], seed: int | Column, k: int = 5, residual: str | None = None, fill_value: str = "random", by: str | None = None) -> DataFrame:
    """Predictive mean matching: a missing cell takes a value of one of its k nearest donors, or their mean.

    Donors are ordered by their prediction. Equal-count ranges of predictions
    are the partitions; each range gets the k last donors below it and the k
    first above it, from as many ranges as these take, so that the k nearest
    are exact for any number of ranges. A range is a task, not the table. Groups
    (``by``) match among their own. ``residual``: "plain" adds the donor's
    prediction less the cell's, "classic" the cell's less the donor's.
    """
    spark = df.sparkSession
    marked = df.withColumn("__mis", is_missing(df, target)).withColumn("__hat", hat).withColumn("__g", F.col(f"`{by}`") if by else F.lit(0)).withColumn("__seed", seed if isinstance(seed, Column) else F.lit(str(seed)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(pool.approxQuantile("__hat", [i / parts for i in range(1, parts)], 0.001)))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    held = F.from_json(F.lit(json.dumps(cuts)), "array<double>")
    part = lambda c: F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(held, a + s - 1) <= c), a + s).otherwise(a)) if cuts else F.lit(0)
    pool = pool.withColumn("__part", part(F.col("__hat")))
    last = W.partitionBy("__g", "__part").orderBy(F.desc("__hat"), "__h")
    first = W.partitionBy("__g", "__part").orderBy("__hat", "__h")
    edge = pool.withColumn("__l", F.row_number().over(last)).withColumn("__f", F.row_number().over(first)).where(f"__l <= {k} OR __f <= {k}")
    # one row for each filled range: its outer donors, and by a window over k of these rows the k nearest on either side
    donor = F.struct("__hat", "__h", "__y")
    ends = edge.groupBy("__g", "__part").agg(F.sort_array(F.collect_list(F.when(F.col("__f") <= k, donor))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("__l") <= k, donor)), False).alias("tail"))
    order = W.partitionBy("__g").orderBy("__part")
    tails, heads = F.collect_list("tail").over(order.rowsBetween(1 - k, 0)), F.collect_list("head").over(order.rowsBetween(0, k - 1))
    reach = ends.select("__g", "__part", F.lag("__part").over(order).alias("__prev"), F.lead("__part").over(order).alias("__next"), F.slice(F.sort_array(F.flatten(tails), False), 1, k).alias("__up"), F.slice(F.sort_array(F.flatten(heads)), 1, k).alias("__down"))
    # the ranges up to the next filled one take the donors below, those down to the filled one before take the donors above
    top = F.lit(len(cuts))
    up = reach.select("__g", F.explode(F.when(F.col("__part") < top, F.sequence(F.col("__part") + 1, F.coalesce("__next", top)))).alias("__part"), "__up").select("__g", "__part", F.explode("__up").alias("g"))
    down = reach.select("__g", F.explode(F.when(F.col("__part") > 0, F.sequence(F.coalesce("__prev", F.lit(0)), F.col("__part") - 1))).alias("__part"), "__down").select("__g", "__part", F.explode("__down").alias("g"))
    allotted = pool.unionByName(up.unionByName(down).select("__g", "g.__hat", "g.__y", "g.__h", "__part"))
    asked = marked.where("__mis").withColumn("__part", part(F.col("__hat")))
    d = F.struct(F.col("__hat").alias("hat"), F.col("__y").alias("y"))
    both = allotted.select("__g", "__part", "__hat", "__h", d.alias("__d"), F.lit(None).cast(asked.select(F.struct(*[f"`{c}`" for c in asked.columns])).dtypes[0][1]).alias("__row")).unionByName(
        asked.select("__g", "__part", "__hat", F.xxhash64(*[f"`{c}`" for c in key]).alias("__h"), F.lit(None).cast("struct<hat:double,y:double>").alias("__d"), F.struct(*[f"`{c}`" for c in asked.columns]).alias("__row"))
    )
    up = W.partitionBy("__g", "__part").orderBy("__hat", F.col("__row").isNotNull(), "__h")
    number = F.count("__d").over(up.rowsBetween(W.unboundedPreceding, 0))
    ranked = both.withColumn("__n", number)
    # donors k before and after in the order, as arrays by a frame over donor numbers
    frame = W.partitionBy("__g", "__part").orderBy("__n").rangeBetween(-(k - 1), k)
    near = ranked.withColumn("__near", F.when(F.col("__row").isNotNull(), F.filter(F.collect_list(F.when(F.col("__row").isNull(), F.col("__d"))).over(frame), lambda x: x.isNotNull()))).where("__row IS NOT NULL")
    best = F.slice(F.array_sort(F.transform("__near", lambda x: F.struct(F.abs(x["hat"] - F.col("__hat")).alias("gap"), x["hat"].alias("hat"), x["y"].alias("y")))), 1, k)
    u = uniform(F.col("__row.__seed"), target, *[f"__row.`{c}`" for c in key])
    one = F.element_at(best, (F.floor(u * F.least(F.lit(k), F.size(best))) + 1).cast("int"))
    gap = {None: lambda x: F.lit(0.0), "plain": lambda x: x["hat"] - F.col("__hat"), "classic": lambda x: F.col("__hat") - x["hat"]}[residual]
    moved = lambda x: x["y"] + gap(x)
    value = moved(one) if fill_value == "random" else F.aggregate(best, F.lit(0.0), lambda total, x: total + moved(x)) / F.size(best)
    done = near.withColumn("__best", best).withColumn("__v", value)
    cells = [F.col("__v").cast(df.schema[c].dataType).alias(c) if c == target else F.col(f"__row.`{c}`").alias(c) for c in df.columns]
    return marked.where("NOT __mis").select(*[f"`{c}`" for c in df.columns]).unionByName(done.select(*cells))


def _priors(kw: dict) -> dict | None:
    """The prior arguments that were given, or None for flat priors."""
    given = {c: kw[c] for c in PRIORS if kw.get(c) is not None}
    return given or None


def _coefficients(model: Linear, strategy: str, seed: int, kw: dict) -> dict:
    """The coefficients with which a strategy predicts missing cells: least squares', the posterior's mean, a draw, or (``draws``) a draw for each row."""
    given, how = _priors(kw), kw.get("fill_value")
    matching = strategy in ("pmm", "lrd")
    if not matching and strategy != "bayesian least squares":
        return {"beta": model.beta.tolist()}
    if given is None:
        if not matching and how != "random":
            return {"beta": model.beta.tolist()}
        beta = draw(model, seed)
        if matching and kw.get("joint") is False:
            beta = np.concatenate([draw(model, seed + 1)[:1], beta[1:]])
        return {"beta": beta.tolist()}
    if matching:  # priors lie about least squares, unless said otherwise
        given = {"am": float(model.beta[0]), "bm": model.beta[1:], **given}
    found = gibbs(model.sums, **given, sample=kw.get("sample", 1000), tune=kw.get("tune", 1000), seed=seed)
    if matching:
        return {"beta": found.draw(np.random.default_rng(seed), kw.get("joint", False)).tolist()}
    out = {"beta": found.mean.tolist()}
    if how == "random":
        out |= {"draws": found.coefs.tolist(), "sigmas": found.sigma.tolist() if kw.get("predictive") else None}
    return out


KNOWN = {*PRIORS, "neighbors", "fill_value", "thresh", "sample", "tune", "joint", "residual", "predictive"}


def fit(source: DataFrame, target: str, strategy: str, names: list[str], key: list[str], seed: int | dict = 0, by: str | None = None, plan: Design | None = None, models: dict[Any, Linear] | None = None, **kw: Any) -> tuple[dict, dict[str, DataFrame]]:
    """What the strategy learns from ``source``: params by group (None without ``by``) of plain values, and tables.

    neighbors, fill_value ("mean" or "random") and residual of pmm and lrd; fill_value
    of the Bayesian strategies: the posterior's mean, unless said otherwise, or a
    draw. am, asd, bm, bsd, sig, sample, tune: priors and length of the sampler; with
    none of the priors they are flat, where the mean is least squares and a draw
    is in closed form; of those left out the rest are 0, 10, 0, 10, 1 (pmm and lrd:
    am and bm at least squares). With priors, pmm and lrd draw intercept and
    slopes apart unless ``joint``, and "random" Bayesian least squares draws for
    each row, with noise if ``predictive``. thresh: the chance above which
    Bayesian logistic regression gives the larger value. ``models``: least
    squares by group, where they are known.
    """
    if set(kw) - KNOWN:
        raise TypeError(f"unknown arguments of {strategy}: {sorted(set(kw) - KNOWN)}")
    if kw.get("fill_value") not in (None, "mean", "random"):
        raise ValueError(f"fill_value is mean or random, not {kw['fill_value']}")
    if kw.get("neighbors", 5) < 1:
        raise ValueError("neighbors is at least 1")
    if kw.get("residual") not in (None, "plain", "classic"):
        raise ValueError(f"residual is plain or classic, not {kw['residual']}")
    if strategy == "default predictive":
        strategy = "pmm" if is_numeric(source, target) else "multinomial logistic"
    seeds = seed if isinstance(seed, dict) else {None: seed}
    if strategy.endswith("logistic"):
        if by is not None:
            raise ValueError(f"{strategy} is fitted by group one after another")
        one = (_fit_bayesian_logistic if strategy.startswith("bayes") else _fit_logistic)(source, target, strategy, names, seeds[None], plan, kw)
        return {None: {"strategy": strategy, **one}}, {}
    if not is_numeric(source, target):
        raise TypeError(f"{strategy} needs a numeric column: {target}")
    models = linear_fits(source, target, names, by, plan) if models is None else models
    out = {}
    for g, m in models.items():
        rest = {"terms": [list(t) for t in m.design.terms], "mse": m.mse, "n": m.n, "fit": m.beta.tolist()}
        if strategy in ("pmm", "lrd") or strategy == "bayesian least squares":
            rest |= {"cov": m.cov.tolist(), "mean": m.sums.mean.tolist(), "products": m.sums.products.tolist()}
        if strategy in ("pmm", "lrd"):
            rest |= {"neighbors": kw.get("neighbors", 5), "fill_value": kw.get("fill_value") or "random", "residual": (kw.get("residual") or "plain") if strategy == "lrd" else None}
        out[g] = {"strategy": strategy, **rest, **_coefficients(m, strategy, seeds[g], kw)}
    tables = {}
    if strategy in ("pmm", "lrd"):
        hat = next(iter(models.values())).design.dot(source, {g: p["fit"] for g, p in out.items()}, by)
        tables["pool"] = pool(source, target, hat, usable(source, names), key, by)
    return out, tables


def reseeded(params: dict[Any, dict], seed: int, kw: dict) -> dict[Any, dict]:
    """The fit of another seed, from the sums that it keeps: no pass over data."""
    out = {}
    for g, p in params.items():
        if "products" in p:
            model = Linear(Design(tuple((c, v) for c, v in p["terms"]), {}), np.array(p["fit"]), np.array(p["cov"]), p["mse"], p["n"], Sums(p["n"], np.array(p["mean"]), np.array(p["products"])))
            p = {**p, **_coefficients(model, p["strategy"], seed, kw)}
        elif "spread" in p:
            p = {**p, "coefs": [_drawn_logistic(np.array(p["mode"]), np.array(p["spread"]), seed)]}
        out[g] = p
    return out


def _drawn_logistic(mode: np.ndarray, cov: np.ndarray, seed: int) -> list[float]:
    return np.random.default_rng(seed).multivariate_normal(mode, cov, method="eigh").tolist()


def apply(df: DataFrame, target: str, params: dict[Any, dict], tables: dict[str, DataFrame], key: list[str], seed: int | dict = 0, by: str | None = None) -> DataFrame:
    """df with the missing cells of ``target`` filled. Missing predictors count as the mean or the most frequent value among the rows to be filled."""
    one = next(iter(params.values()))
    strategy, gone = one["strategy"], is_missing(df, target)
    plan = Design(tuple((c, v) for c, v in one["terms"]), {})
    lost = [c for c in plan.names if c not in df.columns]
    if lost:
        raise ValueError(f"predictors are absent: {lost}")
    plan = replace(plan, fills=fills(df.where(gone), plan, by))
    betas = {g: p["beta"] for g, p in params.items() if "beta" in p}
    seeds = seed if isinstance(seed, dict) else {None: seed}
    drawn_by = F.lit(str(seeds[None])) if by is None else by_group({g: str(s) for g, s in seeds.items()}, by)
    if strategy.endswith("logistic"):
        value = _most_likely(one, plan, df)
    elif strategy in ("pmm", "lrd"):
        return matched(df, target, plan.dot(df, betas, by), tables["pool"], key, drawn_by, one["neighbors"], one["residual"], one["fill_value"], by)
    elif one.get("draws"):
        value = _dot_draws(params, plan.array(df, by), by, drawn_by, target, key)
    else:
        value = plan.dot(df, betas, by)
    if strategy == "stochastic":
        value = value + by_group({g: p["mse"] ** 0.5 for g, p in params.items()}, by) * normal(drawn_by, target, *key)
    return df.withColumn(target, F.when(gone, value).otherwise(F.col(f"`{target}`")))


def _dot_draws(params: dict[Any, dict], x: Column, by: str | None, seed: Column, target: str, key: list[str]) -> Column:
    """A draw of the coefficients for each row, and its noise where ``sigmas`` are given."""
    number = len(next(iter(params.values()))["draws"])
    at = F.floor(uniform(seed, target + "/draw", *key) * number).cast("int")
    held = lambda name, kind: by_group({g: json.dumps(p[name]) for g, p in params.items()}, by) if by else F.lit(json.dumps(params[None][name]))
    draws = F.get(F.from_json(held("draws", "d"), "array<array<double>>"), at)
    total = F.aggregate(F.zip_with(draws, F.concat(F.array(F.lit(1.0)), x), lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    if next(iter(params.values())).get("sigmas"):
        total = total + F.get(F.from_json(held("sigmas", "s"), "array<double>"), at) * normal(seed, target, *key)
    return total


def fill(df: DataFrame, target: str, strategy: str, names: list[str], key: list[str], seed: int = 0, source: DataFrame | None = None, **kw: Any) -> DataFrame:
    """Missing cells of ``target`` by the strategy, fitted on ``source`` (df itself, unless given); see ``fit``."""
    params, tables = fit(df if source is None else source, target, strategy, names, key, seed, **kw)
    return apply(df, target, params, tables, key, seed)


def _complete(source: DataFrame, target: str, names: list[str], most: int) -> tuple[DataFrame, list]:
    """Rows to fit a classification on, and the target's sorted values, at most ``most`` + 1 of them."""
    full = source.where(~is_missing(source, target))
    for c in names:
        full = full.where(~is_missing(source, c))
    return full, [r[0] for r in full.select(f"`{target}`").distinct().orderBy(f"`{target}`").limit(most + 1).collect()]


def _fit_bayesian_logistic(source: DataFrame, target: str, strategy: str, names: list[str], seed: int, plan: Design | None, kw: dict) -> dict:
    """The posterior of the coefficients is taken to be normal about its mode; slopes of standardised predictors are N(bm, bsd^2), by default N(0, 1).

    "mean": chances are those at the mode; "random": at a draw of the coefficients.
    """
    plan = plan or design(source, names, fill=False)
    full, levels = _complete(source, target, usable(source, names), 2)
    if len(levels) not in (1, 2):
        raise ValueError(f"{strategy} can't take {len(levels)} categories of {target}")
    if len(levels) == 1:
        return {"levels": levels, "terms": [], "coefs": [], "thresh": 0.5}
    cols = plan.columns(full)
    flat = full.select(F.lit(0).alias("g"), (F.col(f"`{target}`") == F.lit(levels[1])).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    beta, cov, n = irls(flat, len(cols), [0], ridge=1.0 / kw.get("bsd", 1.0) ** 2, at=float(kw.get("bm", 0.0)), ridge_0=0.0 if kw.get("asd") is None else 1.0 / kw["asd"] ** 2, at_0=float(kw.get("am", 0.0)))[0]
    out = {"levels": levels, "terms": [list(t) for t in plan.terms], "coefs": [beta.tolist()], "thresh": kw.get("thresh", 0.5)}
    if kw.get("fill_value") == "random":
        out |= {"coefs": [_drawn_logistic(beta, cov, seed)], "mode": beta.tolist(), "spread": cov.tolist()}
    return out


def _fit_logistic(source: DataFrame, target: str, strategy: str, names: list[str], seed: int, plan: Design | None, kw: dict) -> dict:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    plan = plan or design(source, names, fill=False)
    full, levels = _complete(source, target, usable(source, names), LEVELS)
    if len(levels) > LEVELS or not levels or strategy.startswith("binary") and len(levels) > 2:
        raise ValueError(f"{strategy} can't take {len(levels)} categories of {target}")
    if len(levels) == 1:
        return {"levels": levels, "terms": [], "coefs": [], "thresh": 0.5}
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(f"`{target}`")) - 1
    train = full.select(code.cast("double").alias("label"), array_to_vector(plan.array(full) if plan.terms else F.array(F.lit(0.0))).alias("features"))
    n = train.count()
    model = LogisticRegression(regParam=1.0 / n, family="binomial" if len(levels) == 2 else "multinomial", standardization=False).fit(train)
    slopes = model.coefficientMatrix.toArray()[:, : len(plan.terms)]
    return {"levels": levels, "terms": [list(t) for t in plan.terms], "coefs": np.column_stack([model.interceptVector.toArray(), slopes]).tolist(), "thresh": 0.5}


def _most_likely(params: dict, plan: Design, df: DataFrame) -> Column:
    """The larger value where its chance exceeds ``thresh``; of more values the one with the largest score, the first of equals."""
    levels, coefs = params["levels"], params["coefs"]
    if len(levels) == 1:
        return F.lit(levels[0])
    if len(coefs) == 1:
        p = 1 / (1 + F.exp(-plan.dot(df, {None: coefs[0]})))
        return F.when(p > params["thresh"], F.lit(levels[1])).otherwise(F.lit(levels[0]))
    scores = F.array(*[plan.dot(df, {None: w}) for w in coefs])
    return F.element_at(F.array(*[F.lit(x) for x in levels]), F.array_position(scores, F.array_max(scores)).cast("int"))
