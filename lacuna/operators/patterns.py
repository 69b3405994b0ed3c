"""Missingness patterns. One aggregate over the table gives all pair counts; the rest works on p * p rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import is_missing


def _seen(df: DataFrame, c: str) -> Column:
    return (~is_missing(df, c)).cast("int")


def md_locations(df: DataFrame, both: bool = False) -> DataFrame:
    """1 where a cell is missing; with ``both`` the table and, as ``<col>_missing``, its indicators."""
    marks = [is_missing(df, c).cast("int").alias(f"{c}_missing" if both else c) for c in df.columns]
    return df.select(*([f"`{c}`" for c in df.columns] if both else []), *marks)


def md_pairs(df: DataFrame) -> DataFrame:
    """var_j, var_k and the rows in which both, only j, only k, neither is observed (rr, rm, mr, mm)."""
    cols = df.columns
    name = {(j, k): f"p{j}_{k}" for j in range(len(cols)) for k in range(j, len(cols))}
    flat = df.select(*[_seen(df, c).alias(f"r{i}") for i, c in enumerate(cols)])
    sums = flat.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(f"r{j}") * F.col(f"r{k}")), F.lit(0)).alias(v) for (j, k), v in name.items()])
    at = lambda j, k: F.col(name[min(j, k), max(j, k)])
    cells = [
        F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(a).alias("var_j"), F.lit(b).alias("var_k"), at(j, k).alias("rr"), (at(j, j) - at(j, k)).alias("rm"), (at(k, k) - at(j, k)).alias("mr"), (F.col("n") - at(j, j) - at(k, k) + at(j, k)).alias("mm"))
        for j, a in enumerate(cols)
        for k, b in enumerate(cols)
    ]
    return sums.select(F.inline(F.array(*cells))).select("var_j", "var_k", "rr", "rm", "mr", "mm")


def as_matrix(long: DataFrame, value: str, columns: list[str] | None = None) -> DataFrame:
    """A table of pairs as a matrix: var_j, and a column for each var_k, in the order of ``columns`` (by name, unless given)."""
    if columns is None:
        columns = sorted(r[0] for r in long.select("var_k").distinct().collect())
    if "var_j" in columns:
        raise ValueError("no column may be named var_j")
    return long.groupBy("var_j").agg(*[F.max(F.when(F.col("var_k") == c, F.col(value))).alias(c) for c in columns])


def md_pattern(df: DataFrame) -> DataFrame:
    """Each pattern of observed cells (1), its rows (count) and its missing cells (nmis)."""
    marked = df.select(*[_seen(df, c).alias(c) for c in df.columns])
    nmis = F.lit(len(df.columns))
    for c in df.columns:
        nmis = nmis - F.col(f"`{c}`")
    return marked.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("count")).withColumn("nmis", nmis)


def inbound(df: DataFrame) -> DataFrame:
    """Of the rows with j missing, the share with k observed; null for a complete j."""
    return md_pairs(df).select("var_j", "var_k", F.try_divide(F.col("mr"), F.col("mr") + F.col("mm")).alias("inbound"))


def outbound(df: DataFrame) -> DataFrame:
    """Of the rows with j observed, the share with k missing."""
    return md_pairs(df).select("var_j", "var_k", F.try_divide(F.col("rm"), F.col("rm") + F.col("rr")).alias("outbound"))


def flux(df: DataFrame) -> DataFrame:
    """pobs, influx, outflux and the mean in- and outbound statistics (ainb, aout) of each column."""
    other = F.col("var_j") != F.col("var_k")
    p = len(df.columns)
    mean = lambda a, b: F.try_divide(F.coalesce(F.sum(F.when(other, F.try_divide(F.col(a), F.col(a) + F.col(b)))), F.lit(0.0)), F.lit(p - 1))
    return (
        md_pairs(df)
        .groupBy(F.col("var_j").alias("column"))
        .agg(
            F.max(F.when(~other, F.try_divide(F.col("rr"), F.col("rr") + F.col("mm")))).alias("pobs"),
            F.try_divide(F.sum("mr"), F.sum(F.col("mr") + F.col("rr"))).alias("influx"),
            F.try_divide(F.sum("rm"), F.sum(F.col("rm") + F.col("mm"))).alias("outflux"),
            mean("mr", "mm").alias("ainb"),
            mean("rm", "rr").alias("aout"),
        )
    )


def influx(df: DataFrame) -> DataFrame:
    return flux(df).select("column", "influx")


def outflux(df: DataFrame) -> DataFrame:
    return flux(df).select("column", "outflux")


def proportions(df: DataFrame) -> DataFrame:
    """Shares of missing (poms) and observed (pobs) cells of each column."""
    return flux(df).select("column", (1 - F.col("pobs")).alias("poms"), "pobs")


def nullity_cov(df: DataFrame) -> DataFrame:
    """Sample covariance of the missing indicators of each pair of columns."""
    n = F.col("rr") + F.col("rm") + F.col("mr") + F.col("mm")
    mj, mk = F.col("mr") + F.col("mm"), F.col("rm") + F.col("mm")
    return md_pairs(df).select("var_j", "var_k", F.try_divide(F.col("mm") - F.try_divide(mj * mk, n), n - 1).alias("cov"))


def nullity_corr(df: DataFrame, method: str = "pearson") -> DataFrame:
    """Correlation of the missing indicators; for 0/1 data the three methods agree. Constant columns are left out."""
    if method not in ("pearson", "kendall", "spearman"):
        raise ValueError(f"unknown method: {method}")
    cov = nullity_cov(df)
    own = lambda v: F.max(F.when(F.col("var_j") == F.col("var_k"), F.col("cov"))).over(W.partitionBy(v))
    both = cov.withColumn("vj", own("var_j")).withColumn("vk", own("var_k")).where("vj > 0 AND vk > 0")
    return both.select("var_j", "var_k", (F.col("cov") / F.sqrt(F.col("vj") * F.col("vk"))).alias("corr"))
