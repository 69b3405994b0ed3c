"""The tables behind plots of missing and imputed cells: each is an aggregate or a projection, ready for any plotting library.

``imputer`` is a ``MultipleImputer`` or ``MiceImputer``; it is fitted on the
table given. Tables of imputations have ``imp_num`` from 1 and, where observed
cells are shown apart, rows of ``imp_num`` 0 for these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, is_numeric, observed
from . import patterns
from .checks import missing_counts


def _some_missing(df: DataFrame) -> None:
    counts = missing_counts(df)
    if not any(n for c, n in counts.items() if c):
        raise ValueError("no cell is missing")


def _has(df: DataFrame, *names: str) -> None:
    lost = [c for c in names if c not in df.columns]
    if lost:
        raise ValueError(f"columns are absent: {lost}")


def percent(df: DataFrame) -> DataFrame:
    """Missing cells of each column, and their percentage."""
    own = patterns.md_pairs(df).where("var_j = var_k")
    return own.select(F.col("var_j").alias("column"), F.col("mm").alias("n_missing"), (100 * F.try_divide(F.col("mm"), F.col("rr") + F.col("mm"))).alias("percent"))


def correlation(df: DataFrame, method: str = "pearson") -> DataFrame:
    """``nullity_corr``; an error if no cell is missing."""
    _some_missing(df)
    return patterns.nullity_corr(df, method)


def distances(df: DataFrame) -> DataFrame:
    """Euclidean distance between the missing indicators of two columns."""
    return patterns.md_pairs(df).select("var_j", "var_k", F.sqrt((F.col("rm") + F.col("mr")).cast("double")).alias("distance"))


def dendrogram(df: DataFrame) -> list[tuple[frozenset[str], frozenset[str], float]]:
    """The merges of an average linkage of the columns by ``distances``: both clusters and their distance, nearest first.

    Only the distances of columns reach the driver; ties go to the first columns.
    """
    _some_missing(df)
    at = {c: i for i, c in enumerate(df.columns)}
    apart = np.full((len(at), len(at)), np.inf)
    for r in distances(df).where("var_j <> var_k").collect():
        apart[at[r.var_j], at[r.var_k]] = r.distance
    held = [frozenset([c]) for c in df.columns]
    left, merges = set(range(len(held))), []
    while len(left) > 1:
        i, j = sorted(divmod(int(apart.argmin()), len(held)))
        merges.append((held[i], held[j], float(apart[i, j])))
        mean = (len(held[i]) * apart[i] + len(held[j]) * apart[j]) / (len(held[i]) + len(held[j]))
        held[i] |= held[j]
        left.remove(j)
        apart[i] = apart[:, i] = np.where(np.isin(np.arange(len(held)), list(left - {i})), mean, np.inf)
        apart[j] = apart[:, j] = np.inf
    return merges


def scatter(df: DataFrame, single, x: str, y: str, color: str | None = None) -> DataFrame:
    """x, y of a single imputation, and whether ``color`` (x or y; either, unless given) was imputed."""
    _has(df, x, y)
    if color not in (None, x, y):
        raise ValueError("color is x or y")
    gone = is_missing(df, color) if color else is_missing(df, x) | is_missing(df, y)
    done = single.fit(df).transform(df.withColumn("__imputed", gone))
    return done.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"), F.col("__imputed").alias("imputed"))


def melted(df: DataFrame, imputer, column: str, share: float = 1.0) -> DataFrame:
    """imp_num, value and imputed of a column in all imputations: the points of strip and swarm plots.

    ``share`` below 1 samples the points to draw.
    """
    _has(df, column)
    done = imputer.fit(df).transform(df.withColumn("__imputed", is_missing(df, column)))
    long = done.select("imp_num", F.col(f"`{column}`").alias("value"), F.col("__imputed").alias("imputed"))
    return long if share >= 1 else long.sample(share, seed=imputer.getOrDefault("seed"))


def _with_observed(df: DataFrame, imputer, column: str) -> DataFrame:
    _has(df, column)
    if not is_numeric(df, column):
        raise TypeError(f"not a numeric column: {column}")
    seen = df.select(F.lit(0).alias("imp_num"), observed(df, column).cast("double").alias("value")).where("value IS NOT NULL")
    return seen.unionByName(melted(df, imputer, column).select("imp_num", F.col("value").cast("double").alias("value")))


def histogram(df: DataFrame, imputer, column: str, bins: int = 50) -> DataFrame:
    """imp_num, bin, low, high, count: the column's distribution in each imputation and among observed cells, over bins of one width.

    Empty bins have no row; if all values are equal, there is one bin.
    """
    if bins < 1:
        raise ValueError("bins is at least 1")
    long = _with_observed(df, imputer, column)
    low, high = long.agg(F.min("value"), F.max("value")).first()
    width = ((high - low) / bins if low is not None else 0.0) or 1.0
    place = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = long.groupBy("imp_num", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edge = lambda c: F.lit(low) + F.lit(width) * c
    return counts.select("imp_num", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "count")


def density(df: DataFrame, imputer, column: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """imp_num, point, x, density: a Gaussian kernel density of the column in each imputation and among observed cells.

    The points of one grid reach a tenth of the range beyond it at either side.
    Values count at their nearest point, so that no more than the points of each
    imputation meet. The bandwidth is Scott's, sd * n^(-1/5), unless given; of
    values that are all equal there is no density and no row.
    """
    if points < 2 or bandwidth is not None and bandwidth <= 0:
        raise ValueError("points is at least 2 and bandwidth above 0")
    long = _with_observed(df, imputer, column)
    low, high = long.agg(F.min("value"), F.max("value")).first()
    margin = ((high - low) / 10) if low is not None else 0.0
    start, step = (low or 0.0) - margin, ((high or 0.0) - (low or 0.0) + 2 * margin) / (points - 1)
    place = F.floor((F.col("value") - F.lit(start)) / F.lit(step) + 0.5).cast("int") if step else F.lit(0)
    # from each point's own sums: a bin's count and moments give n and the deviation of all
    bins = long.groupBy("imp_num", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spread = long.groupBy("imp_num").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"))
    held = bins.groupBy("imp_num").agg(F.collect_list(F.struct("bin", "count")).alias("bins")).join(spread, "imp_num")
    h = F.lit(float(bandwidth)) if bandwidth else F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    each = held.withColumn("h", h).where("h > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    kernel = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["count"] * F.exp(-0.5 * F.pow((F.col("point") - b["bin"]) * F.lit(step) / F.col("h"), F.lit(2.0))))
    return each.select("imp_num", "point", (F.lit(start) + F.lit(step) * F.col("point")).alias("x"), (kernel / (F.col("n") * F.col("h") * (2 * np.pi) ** 0.5)).alias("density"))


def boxplots(df: DataFrame, imputer, column: str, accuracy: int | None = None) -> DataFrame:
    """imp_num, count, min, q1, median, q3, max of the column in each imputation and among observed cells.

    Exact quartiles hold a table of the distinct values in memory; with
    ``accuracy`` they are those of percentile_approx, of bounded size.
    """

    def quartile(p: float) -> Column:
        return F.percentile("value", p) if accuracy is None else F.percentile_approx("value", p, accuracy)

    parts = [quartile(p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return _with_observed(df, imputer, column).groupBy("imp_num").agg(F.count("value").alias("count"), F.min("value").alias("min"), *parts, F.max("value").alias("max"))
