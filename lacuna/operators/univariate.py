"""Strategies that fill a column from its own observed values.

``fit`` turns the columns' statistics into aggregates that run in one pass over
the table; ``fill`` makes the Column that replaces missing cells. Draws depend
on the row's key and the seed alone.
"""

from __future__ import annotations

from random import Random
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import digest, drawn, is_missing, is_numeric, normal, observed

NUMERIC = ("mean", "median", "norm", "normal unit variance")
BY_COUNTS = ("mode", "random", "categorical")
STRATEGIES = ("mean", "median", "mode", "random", "norm", "normal unit variance", "categorical", "default univariate")
#: Hashed buckets of distinct values for each shuffle partition. So few distinct values (five rows each) are broadcast.
BUCKETS = 4
SMALL = 10_000


def resolve(df: DataFrame, column: str, strategy: str) -> str:
    if strategy == "default univariate":
        return "mean" if is_numeric(df, column) else "mode"
    if strategy in NUMERIC and not is_numeric(df, column):
        raise TypeError(f"{strategy} needs a numeric column: {column}")
    if strategy == "categorical" and is_numeric(df, column):
        raise TypeError(f"categorical needs a string column: {column}")
    return strategy


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct observed values with their counts."""
    return df.select(observed(df, column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, columns: dict[str, str]) -> dict[str, dict[str, float]]:
    """The aggregates of all numeric strategies, in one pass."""
    aggs = []
    for c, s in columns.items():
        x = observed(df, c).cast("double")
        aggs.append(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), (F.median(x) if s == "median" else F.lit(None).cast("double")).alias("median")))
    if not aggs:
        return {}
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    return {c: row[i].asDict() for i, c in enumerate(columns)}


def modes(df: DataFrame, column: str) -> DataFrame:
    """The most frequent values with their count."""
    counts = value_counts(df, column)
    return counts.where(F.col("n") == F.lit(counts.agg(F.max("n")).first()[0]))


def mode_of(df: DataFrame, column: str, fill_strategy: str | None = None) -> Any:
    """The smallest ('first', None) or largest ('last') of the most frequent values."""
    return modes(df, column).agg((F.max if fill_strategy == "last" else F.min)("value")).first()[0]


def fit(df: DataFrame, plan: dict[str, str], kwargs: dict[str, dict] | None = None, seed: int = 0) -> dict[str, dict]:
    """Fitted parameters by column."""
    asked, plan = plan, {c: resolve(df, c, s) for c, s in plan.items()}
    stats = moments(df, {c: s for c, s in plan.items() if s in NUMERIC})
    out = {}
    for c, s in plan.items():
        p = {"strategy": s, "kind": df.schema[c].dataType.simpleString(), **stats.get(c, {})}
        if s in NUMERIC and p["n"] == 0:
            raise ValueError(f"all values missing in {c}")
        p = reseeded(c, p, seed)
        if s == "mode":
            how = ((kwargs or {}).get(c) or {}).get("fill_strategy", "random" if asked[c] == "default univariate" else None)
            p["tied"] = how == "random"
            p["value"] = mode_of(df, c, how)
            if p["value"] is None:
                raise ValueError(f"all values missing in {c}")
        out[c] = p
    return out


def reseeded(column: str, params: dict, seed: int) -> dict:
    """The parameters for another seed: only the shared draw of a normal of unit variance depends on it."""
    if params["strategy"] != "normal unit variance":
        return params
    return {**params, "mu": params["mean"] + Random(f"{seed}/{column}").gauss(0, 1) / params["n"] ** 0.5}


def weights(source: DataFrame, column: str, params: dict) -> DataFrame | None:
    """The values among which a fit draws, with their counts; None where nothing is drawn among values."""
    if params["strategy"] == "mode" and params["tied"]:
        return modes(source, column)
    return value_counts(source, column) if params["strategy"] in ("random", "categorical") else None


def _pick(df: DataFrame, column: str, strategy: str, seed: int, key: list[str], weights: DataFrame) -> DataFrame:
    """Fill by a draw among distinct values ('random': each alike; 'mode': the most frequent alike; else by frequency).

    Each value has a range of [0, total) as long as its weight; values lie in
    the order of a hash. Buckets are runs of this order: their sums go to the
    driver, and each adds up its own values, so that neither their number nor
    how rows are partitioned changes a draw. A row
    draws a whole number below total and meets the ranges of its cell by an
    equi-join; with a quarter of the mean weight as a cell, a draw compares
    with 5/4 ranges on average.
    """
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = weights.withColumn("h", digest(F.col("value")))
    weights = weights.select("value", "h", F.shiftright(F.shiftright("h", 12) * F.lit(buckets).cast("long"), 40).cast("int").alias("part"), (F.col("n") if strategy == "categorical" else F.lit(1)).cast("long").alias("w"))
    sums = {r[0]: r[1:] for r in weights.groupBy("part").agg(F.sum("w"), F.count(F.lit(1))).collect()}
    if not sums:
        raise ValueError(f"all values missing in {column}")
    starts, total = [], 0
    for i in range(buckets):
        starts.append(total)
        total += sums.get(i, (0, 0))[0]
    values = sum(n for _, n in sums.values())
    cell = max(1, total // (4 * values))
    lo = F.get(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("part")) + F.sum("w").over(W.partitionBy("part").orderBy("h", "value")) - F.col("w")
    ranged = weights.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("w"))
    whole = lambda c: F.expr(f"{c} div {cell}")
    ranged = ranged.select("value", "lo", "hi", F.explode(F.sequence(whole("lo"), whole("(hi - 1)"))).alias("__cell"))
    draw = F.when(is_missing(df, column), F.pmod(drawn(seed, column, *key), F.lit(total)))
    marked = df.withColumn("__u", draw).withColumn("__b", whole("__u"))
    gaps = marked.where("__u IS NOT NULL").join(F.broadcast(ranged) if values <= SMALL else ranged, (F.col("__b") == F.col("__cell")) & (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi")), "left")
    cells = [F.col("value").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    return marked.where("__u IS NULL").select(*[f"`{c}`" for c in df.columns]).unionByName(gaps.select(*cells))


def fill(df: DataFrame, params: dict[str, dict], source: DataFrame | dict[str, DataFrame | None], seed: int, key: list[str]) -> DataFrame:
    """All parametric columns in one select; draws among values by a join each. ``source``: the fitted table, or ``weights`` by column."""
    made: dict[str, Column] = {}
    for c, p in params.items():
        s = p["strategy"]
        if s in ("mean", "median"):
            v = F.lit(p[s])
        elif s == "norm":
            v = F.lit(p["mean"]) + F.lit(p["sd"] or 0.0) * normal(seed, c, *key)
        elif s == "normal unit variance":
            # J/n + I: one draw that all cells share, and one of each cell
            v = F.lit(p["mu"]) + normal(seed, c, *key)
        elif s == "mode":
            if p["tied"]:
                continue
            v = F.lit(p["value"]).cast(p["kind"])
        else:
            continue
        made[c] = F.when(is_missing(df, c), v).otherwise(F.col(f"`{c}`"))
    out = df.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])
    for c, p in params.items():
        if p["strategy"] in ("random", "categorical") or p.get("tied"):
            out = _pick(out, c, p["strategy"], seed, key, source[c] if isinstance(source, dict) else weights(source, c, p))
    return out


__all__ = ["STRATEGIES", "fill", "fit", "mode_of", "modes", "moments", "reseeded", "resolve", "value_counts", "weights"]
