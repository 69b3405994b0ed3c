"""Strategies that fill a column along an order, within each key of ``partition``.

Where every series is small, a series is a group of a window. Otherwise the rows
are cut into ranges by (partition, order), so that a task holds some
ranges and no whole series; what a range needs from the others (its row offset
and the nearest observed cells outside it) comes from a table with one row for
each series and range. Rows with equal keys are ordered by a hash of their cells.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import is_missing, is_numeric, observed

STRATEGIES = ("locf", "nocb", "interpolate", "default time")
SMOOTH = ("quadratic", "cubic", "polynomial", "spline", "barycentric")


#: A range has about so many rows, or more: there are RANGES for each shuffle partition at most. Series are cut where one has SMALL * LEAST rows or more; results don't depend on it.
LEAST = 1000
SMALL = 64
RANGES = 4
#: Knots beyond a stretch of a spline that its solution takes in, and knots of a stretch. See _curve.
HALO = {1: 64, 2: 64, 3: 64, 4: 128, 5: 128}
STRETCH = 128
#: Points of a curve that are evaluated at once.
POINTS = 1024


def _cut(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """df with __tie and __range, which numbers ranges of about equal size by (partition, order, __tie).

    The cuts are taken from a sample; results don't depend on them.
    """
    out = _with_tie(df)
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate([*partition, *order, "__tie"])])
    n = df.count()
    parts = min(-(-n // LEAST), RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = out.select(key.alias("k"))
    found = [r[0] for r in keys.sample(min(1.0, 50 * parts / n), seed=1).orderBy("k").select(F.to_json("k")).collect()] if parts > 1 else []
    if len(found) < 2:
        return out.withColumn("__range", F.lit(0))
    chosen = sorted({len(found) * i // parts for i in range(1, parts)})
    # times lose digits in JSON, so the order is made again
    cuts = F.sort_array(F.from_json(F.lit("[" + ",".join(found[i] for i in chosen) + "]"), f"array<{keys.schema['k'].dataType.simpleString()}>"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(chosen).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(chosen)) & (F.get(cuts, a + s - 1) <= F.col("__key")), a + s).otherwise(a))
    return out.withColumn("__key", key).withColumn("__range", at).drop("__key")


def _with_tie(df: DataFrame) -> DataFrame:
    """Rows with equal keys are ordered by a hash of their cells."""
    plain = [c for c in df.columns if not any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    return df.withColumn("__tie", F.xxhash64(*[f"`{c}`" for c in plain]))


def _whole(df: DataFrame, column: str, order: list[str], partition: list[str], time: bool) -> tuple[DataFrame, W]:
    """As ``_ranged``, with each series as its only range: windows of one partitioning, so one shuffle and one sort."""
    w = W.partitionBy(*[f"`{c}`" for c in partition]).orderBy(*[f"`{c}`" for c in order], "__tie")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = F.unix_micros(F.col(f"`{order[0]}`").cast("timestamp")) if time else F.lit(None).cast("long")
    rows = _with_tie(df).withColumn("__x", observed(df, column)).withColumn("__row", F.row_number().over(w).cast("long")).withColumn("__t", t).withColumn("__range", F.lit(0))
    knot = F.struct("__row", "__t", "__x")
    mean = F.avg("__x").over(whole) if is_numeric(df, column) and df.schema[column].dataType.typeName() != "boolean" else F.lit(None).cast("double")
    rows = rows.withColumn("__knot", F.when(F.col("__x").isNotNull(), knot))
    none = F.when(F.lit(False), knot)
    facts = {"__offset": F.lit(0).cast("long"), "__ranges": F.lit(1).cast("long"), "__n": F.count(F.lit(1)).over(whole), "__mean": mean, "__before": none, "__after": none, "__first": F.first("__x", True).over(whole), "__last": F.last("__x", True).over(whole)}
    return rows.withColumns(facts), w


def _ranged(df: DataFrame, column: str, order: list[str], partition: list[str], time: bool = False) -> tuple[DataFrame, W]:
    """df with the cell (__x), its knot (row number in the series, time, cell), and the facts of the series and its other ranges; and the window of a range."""
    largest = df.groupBy(*[f"`{c}`" for c in partition]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest < SMALL * LEAST:
        return _whole(df, column, order, partition, time)
    cut = _cut(df, partition, order)
    by = [*[f"`{c}`" for c in partition], "__range"]
    w = W.partitionBy(*by).orderBy(*[f"`{c}`" for c in order], "__tie")
    x = observed(df, column)
    t = F.unix_micros(F.col(f"`{order[0]}`").cast("timestamp")) if time else F.lit(None).cast("long")
    rows = cut.withColumn("__x", x).withColumn("__row", F.row_number().over(w).cast("long")).withColumn("__t", t)
    seen = F.when(F.col("__x").isNotNull(), F.col("__row"))
    knot = F.struct("__row", "__t", "__x")
    total = F.sum("__x") if is_numeric(df, column) and df.schema[column].dataType.typeName() != "boolean" else F.lit(None).cast("double")
    edge = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("__x").alias("seen"), total.alias("sum"), F.min_by(knot, seen).alias("lo"), F.max_by(knot, seen).alias("hi"))
    series = W.partitionBy(*by[:-1])
    along = series.orderBy("__range")
    whole, above, below = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(1, W.unboundedFollowing)
    edge = edge.withColumn("__offset", F.coalesce(F.sum("n").over(above), F.lit(0)))
    for c in ("lo", "hi"):
        edge = edge.withColumn(c, F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.__row") + F.col("__offset")).alias("__row"), F.col(f"{c}.__t").alias("__t"), F.col(f"{c}.__x").alias("__x"))))
    facts = {
        "__offset": F.col("__offset"), "__ranges": F.count(F.lit(1)).over(whole), "__n": F.sum("n").over(whole), "__mean": F.try_divide(F.sum("sum").over(whole), F.sum("seen").over(whole)),
        "__before": F.last("hi", True).over(above), "__after": F.first("lo", True).over(below), "__first": F.first("lo", True).over(whole)["__x"], "__last": F.last("hi", True).over(whole)["__x"],
    }
    edge = edge.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(by)], *[v.alias(c) for c, v in facts.items()])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & (rows[c].eqNullSafe(edge[f"__p{i}"]) if i < len(partition) else rows[c] == edge[f"__p{i}"])
    out = rows.join(edge, same).drop(*[f"__p{i}" for i in range(len(by))]).withColumn("__row", F.col("__row") + F.col("__offset"))
    return out.withColumn("__knot", F.when(F.col("__x").isNotNull(), knot)), w


def _seed(how: Any, first: bool) -> Column:
    return F.col("__first" if first else "__last") if how is None else F.col("__mean") if how == "mean" else F.lit(how)


def _own(df: DataFrame, done: DataFrame, column: str, value: Column) -> DataFrame:
    return done.withColumn(column, value).select(*[f"`{c}`" for c in df.columns])


def locf(df: DataFrame, column: str, order: list[str], partition: list[str] = (), start: Any = None) -> DataFrame:
    """The last observed value; a missing first row gets ``start`` (a value, 'mean', or by default the first observed)."""
    rows, w = _ranged(df, column, order, list(partition))
    before = F.last("__x", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return _own(df, rows, column, F.coalesce(before, F.col("__before.__x"), _seed(start, True)))


def nocb(df: DataFrame, column: str, order: list[str], partition: list[str] = (), end: Any = None) -> DataFrame:
    """The next observed value; a missing last row gets ``end``."""
    rows, w = _ranged(df, column, order, list(partition))
    after = F.first("__x", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return _own(df, rows, column, F.coalesce(after, F.col("__after.__x"), _seed(end, False)))


def interpolate(df: DataFrame, column: str, order: list[str], partition: list[str] = (), method: str = "linear", degree: int | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Between the neighbours: by row ('linear'), by the order column's time ('time'), or by a smooth curve."""
    if not is_numeric(df, column):
        raise TypeError(f"interpolate needs a numeric column: {column}")
    if method == "barycentric":
        return _global(df, column, order, list(partition), start, end)
    if method in SMOOTH:
        return _smooth(df, column, order, list(partition), method, degree, start, end)
    if method not in ("linear", "time"):
        raise ValueError(f"unknown method: {method}")
    cast = df.withColumn(column, observed(df, column).cast("double"))
    rows, w = _ranged(cast, column, order, list(partition), method == "time")
    a = F.coalesce(F.last("__knot", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("__before"))
    b = F.coalesce(F.first("__knot", True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("__after"))
    near = rows.withColumn("__a", a).withColumn("__b", b)
    at = "__row" if method == "linear" else "__t"
    slope = F.try_divide(F.col("__b.__x") - F.col("__a.__x"), (F.col(f"__b.{at}") - F.col(f"__a.{at}")).cast("double"))
    return _own(df, near, column, F.coalesce("__x", F.col("__a.__x") + slope * (F.col(at) - F.col(f"__a.{at}")), "__a.__x", "__b.__x"))


def _polynomial(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial through all knots at the points ``at``, POINTS at once."""
    size = max(1.0, np.ptp(t) / 4) if len(t) else 1.0
    weight, out = np.empty(len(t)), np.empty(len(at))
    for i in range(0, len(t), POINTS):
        gap = (t[i : i + POINTS, None] - t[None, :]) / size
        gap[np.arange(len(gap)), np.arange(i, i + len(gap))] = 1.0
        weight[i : i + POINTS] = np.prod(np.sign(gap), axis=1) * np.exp(-np.log(np.abs(gap)).sum(axis=1))
    for i in range(0, len(at), POINTS):
        diff = at[i : i + POINTS, None] - t[None, :]
        hit = diff == 0
        part = weight / np.where(hit, 1.0, diff)
        out[i : i + POINTS] = np.where(hit.any(axis=1), y[hit.argmax(axis=1)], (part * y).sum(axis=1) / part.sum(axis=1))
    return out


def _curve(t: np.ndarray, y: np.ndarray, at: np.ndarray, method: str, degree: int | None) -> np.ndarray:
    """The interpolating spline at the points ``at``, by stretches of STRETCH knots and HALO more at either side.

    What an end condition does to a cubic spline shrinks at each knot by half
    or more on any knots (its system has 2 on the diagonal and 1 beside it), so
    a halo of 64 leaves 2^-64 of it; for the other degrees see the README.
    """
    if len(t) < 2:
        return np.full(len(at), y[0] if len(y) else np.nan)
    k = {"quadratic": 2, "cubic": 3}.get(method, degree)
    if k is None or not 1 <= k < min(6, len(t)):
        if method in ("polynomial", "spline"):
            raise ValueError("the order must be from 1 to 5 and less than the observed values")
        k = max(1, min(k, len(t) - 1))
    out, halo = np.empty(len(at)), HALO[k]
    if len(t) <= STRETCH + 2 * halo:
        return _spline(t, y, at, k)
    stretch = np.searchsorted(t, at) // STRETCH
    for s in np.unique(stretch):
        mine, span = stretch == s, slice(max(0, s * STRETCH - halo), (s + 1) * STRETCH + halo)
        span = span if len(t[span]) > halo else slice(max(0, len(t) - halo - 1), None)
        out[mine] = _spline(t[span], y[span], at[mine], k)
    return out


def _spline(t: np.ndarray, y: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """An interpolating B-spline: knots at or between the data points, not-a-knot ends."""
    t, at = t - t[0], at - t[0]
    inner = t[(k + 1) // 2 : len(t) - (k + 1) // 2] if k % 2 else ((t[:-1] + t[1:]) / 2)[k // 2 : len(t) - 1 - k // 2]
    knots = np.r_[[t[0]] * (k + 1), inner, [t[-1]] * (k + 1)]

    def basis(x: np.ndarray) -> np.ndarray:
        b = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
        b[x >= t[-1], np.searchsorted(knots, t[-1]) - 1] = 1.0
        for d in range(1, k + 1):
            left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            u = np.divide(x[:, None] - knots[: -d - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
            v = np.divide(knots[d + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
            b = u * b[:, :-1] + v * b[:, 1:]
        return b

    coef = np.linalg.solve(basis(t), y)
    inside = np.clip(at, t[0], t[-1])
    return np.concatenate([basis(inside[i : i + POINTS]) @ coef for i in range(0, len(at), POINTS)]) if len(at) else at


def _seeded(rows: DataFrame, start: Any, end: Any) -> Column:
    """The cell, where a missing first or last row of a series that has any gets its seed."""
    x, some = F.col("__x"), F.col("__first").isNotNull()
    for at, how, first in ((F.lit(1), start, True), (F.col("__n"), end, False)):
        x = F.coalesce(x, F.when(some & (F.col("__row") == at), _seed(how, first).cast("double")))
    return x


def _smooth(df: DataFrame, column: str, order: list[str], partition: list[str], method: str, degree: int | None, start: Any, end: Any) -> DataFrame:
    """A curve through the observed values of a series; each range solves its own part, with the knots around it."""
    cast = df.withColumn(column, observed(df, column).cast("double"))
    rows, _ = _ranged(cast, column, order, partition)
    rows = rows.withColumn("__x", rows["__x"] if method == "spline" else _seeded(rows, start, end)).withColumn("__at", F.col("__row").cast("double"))
    by, size = [*partition, "__range"], max(HALO.values())
    cols = [f"`{c}`" for c in by]
    # series of several ranges: their outer knots, which a fold hands on past thin ranges
    outer = rows.where("__ranges > 1").select(*cols, "__at", "__x")
    up, down = W.partitionBy(*cols).orderBy("__at"), W.partitionBy(*cols).orderBy(F.desc("__at"))
    seen = F.when(F.col("__x").isNotNull(), 1)
    pair = F.struct("__at", "__x")
    outer = outer.withColumn("__f", F.count(seen).over(up)).withColumn("__l", F.count(seen).over(down))
    lists = [F.sort_array(F.collect_list(F.when(seen.isNotNull() & (F.col(c) <= size), pair))) for c in ("__f", "__l")]
    flat = [e for i, c in enumerate(("head", "tail")) for e in (F.transform(c, lambda p: p["__at"]).alias(f"{c}_t"), F.transform(c, lambda p: p["__x"]).alias(f"{c}_y"))]
    edge = outer.groupBy(*cols).agg(lists[0].alias("head"), lists[1].alias("tail")).select(*cols, *flat)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edge.schema.fields[: len(by)])

    def around(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__range").reset_index(drop=True)
        found = []
        for part, turn in (("tail", 1), ("head", -1)):
            t = y = np.empty(0)
            kept = []
            for i in range(len(group))[::turn]:
                kept.append((t, y))
                a, b = (np.asarray(group[f"{part}_{c}"][i], float) for c in "ty")
                t, y = (np.r_[t, a][-size:], np.r_[y, b][-size:]) if turn == 1 else (np.r_[a, t][:size], np.r_[b, y][:size])
            found.append(kept[::turn])
        made = [(np.r_[a[0], b[0]], np.r_[a[1], b[1]]) for a, b in zip(*found)]
        return group[by].assign(t=[m[0] for m in made], y=[m[1] for m in made])

    def run(group: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__at")
        at, y = group["__at"].to_numpy(float), group["__x"].to_numpy(float, na_value=np.nan).copy()
        ok = ~np.isnan(y)
        t, v = at[ok], y[ok]
        for i in range(len(near)):
            t, v = np.r_[t, near["t"].iloc[i]], np.r_[v, near["y"].iloc[i]]
        if len(t) and not ok.all():
            line = np.argsort(t)
            y[~ok] = _curve(t[line], v[line], at[~ok], method, degree)
        return group.assign(**{column: y})[names]

    names = df.columns
    halo = edge.groupBy(*cols[:-1]).applyInPandas(around, f"{keys}, t array<double>, y array<double>")
    cells = rows.select(*[f"`{c}`" for c in names], "__range", "__at", "__x")
    return cells.groupBy(*cols).cogroup(halo.groupBy(*cols)).applyInPandas(run, cast.schema)


def _global(df: DataFrame, column: str, order: list[str], partition: list[str], start: Any, end: Any) -> DataFrame:
    """One polynomial through all observed values of a series; each value depends on each other, so a series is a task."""
    cast = df.withColumn(column, observed(df, column).cast("double"))
    rows, _ = _ranged(cast, column, order, partition)
    rows = rows.withColumn("__x", _seeded(rows, start, end)).withColumn("__at", F.col("__row").cast("double"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at, y = group["__at"].to_numpy(float), group["__x"].to_numpy(float, na_value=np.nan).copy()
        ok = ~np.isnan(y)
        if ok.any() and not ok.all():
            y[~ok] = _polynomial(at[ok], y[ok], at[~ok]) if ok.sum() > 1 else y[ok][0]
        return group.assign(**{column: y})[names]

    names = df.columns
    return rows.select(*[f"`{c}`" for c in names], "__at", "__x").groupBy(*[f"`{c}`" for c in partition]).applyInPandas(run, cast.schema)


def fill(df: DataFrame, column: str, strategy: str, order: list[str], partition: list[str] = (), **kwargs: Any) -> DataFrame:
    if strategy == "default time":
        if is_numeric(df, column):
            return interpolate(df, column, order, partition, **kwargs)
        from . import univariate

        params = univariate.fit(df, {column: "default univariate"})  # one of the most frequent values, drawn for each cell
        return univariate.fill(df, params, df, 0, [*partition, *order])
    return {"locf": locf, "nocb": nocb, "interpolate": interpolate}[strategy](df, column, order, partition, **kwargs)
