"""Mixing sources to target weights, with DataFrame functions only.

Weights go down a tree of columns (domain, language, source). Each node's budget
is split among its children by weight; a child that can't fill its share gets
all it holds and its siblings share the rest, so that a shortage leaves a subtree
only when the whole subtree is exhausted. A leaf is read in seeded epochs: whole
epochs first, then a token-prefix of the next one's order.

The prefix is found without sorting a leaf in one task: documents fall into
buckets by their place in the order, bucket sums give the bucket in which the
prefix ends, and only such buckets are ordered document by document.

Cases: null columns of the tree are a branch of their own; null and empty texts
hold no tokens, are in each whole epoch and cost a prefix nothing, but a leaf of
such texts only has no budget and gives no row; rows that repeat an id and text
share a place in the order, of which a prefix takes as many rows as fit, any of
them; a weight of zero or less gives a branch nothing; an empty table gives an empty result; columns named as the results
are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: Documents that a bucket of a leaf's order holds, about.
BUCKET_ROWS = 2000
MAX_EPOCHS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))), F.lit(0)).cast("long")


def _split(nodes: DataFrame, parent: list[str], tie: list[str]) -> DataFrame:
    """budget of each row by weight and capacity, from the column ``have`` of its parent."""
    ratio = F.col("capacity") / F.col("weight")
    w = W.partitionBy(*parent).orderBy(ratio, *tie)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    full = W.partitionBy(*parent)
    capped = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    rest = F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = nodes.withColumns({"__capped": capped, "__rest": rest, "__r": ratio}).withColumn("__full", F.col("__r") * F.col("__rest") + F.col("__capped") <= F.col("have") + 1e-9)
    held = F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(full), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(full)
    return out.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise((F.col("have") - held) * F.col("weight") / open_)).drop("__capped", "__rest", "__r", "__full")


def budgets(leaves: DataFrame, levels: list[str], total: float, weights: dict[tuple, float] | None = None, epochs: int = MAX_EPOCHS) -> DataFrame:
    """levels, tokens and budget of each leaf. leaves: levels and tokens; weights: by path, 1 where not given."""
    spark = leaves.sparkSession
    base = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    have = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = base.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        own = [(*k, float(v)) for k, v in (weights or {}).items() if len(k) == depth]
        if own:
            given = spark.createDataFrame(own, ", ".join(f"`w{i}` string" for i in range(depth)) + ", w double")
            on = None
            for i, c in enumerate(path):
                eq = F.col(c).cast("string").eqNullSafe(F.col(f"w{i}"))
                on = eq if on is None else on & eq
            nodes = nodes.join(F.broadcast(given), on, "left").select(*path, "capacity", F.coalesce("w", F.lit(1.0)).alias("weight"))  # the caller's literal list
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        nodes = nodes.where("weight > 0")
        if have is None:
            nodes = nodes.withColumn("have", F.least(F.lit(float(total)), F.sum("capacity").over(W.partitionBy())))
        else:
            up = have.select(*[F.col(c).alias(f"u_{c}") for c in path[:-1]], F.col("budget").alias("have"))
            on = None
            for c in path[:-1]:
                eq = F.col(c).eqNullSafe(F.col(f"u_{c}"))
                on = eq if on is None else on & eq
            nodes = nodes.join(up, on).select(*path, "capacity", "weight", "have")
        have = _split(nodes, path[:-1], path)
    return have.select(*levels, (F.col("capacity") / epochs).cast("long").alias("tokens"), "budget")


def mix(docs: DataFrame, levels: dict[str, Column], share: float = 0.5, weights: dict[tuple, float] | None = None, epochs: int = MAX_EPOCHS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen documents with n_tokens, copies (how often each is read) and leaf_budget.

    levels: the tree's columns, from the root. share: the total budget, in parts of all tokens.
    """
    spark = docs.sparkSession
    path = [f"__l{i}" for i in range(len(levels))]
    docs = docs.drop("n_tokens", "copies", "leaf_budget")
    # all of a row is one column, so that no name of its own meets one used here
    made = docs.select(F.struct("*").alias("__row"), word_count(F.col(text_col)).alias("n_tokens"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__t"), *[c.alias(p) for p, c in zip(path, levels.values())])
    # only ids and numbers: the order, the sums and the choice need no text
    slim = materialize(made.drop("__row"), "slim")
    leaves = materialize(slim.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves.where("tokens > 0").select(*path, "tokens"), path, total * share, weights, epochs)
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens") + 1e-9)).withColumn("part", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in path]
    sized = materialize(plan.alias("p").join(leaves.alias("v"), same(plan, leaves)).select(*[plan[c] for c in path], "budget", "whole", "part", F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).alias("buckets")), "plan")
    few = sized.count() <= 100_000
    ready = F.broadcast(sized) if few else sized
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("")), F.col("__t").cast("string")))
    point = F.conv(F.substr(order, F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    placed = slim.join(ready, same(slim, sized)).select(*[slim[c] for c in path], "__id", "__t", "n_tokens", "budget", "whole", "part", order.alias("__o"), F.floor(point * F.col("buckets")).alias("__b"))
    sums = placed.groupBy(*path, "__b").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    upto = W.partitionBy(*path).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    ends = materialize(sums.withColumn("__end", F.sum("n").over(upto)).withColumn("__start", F.col("__end") - F.col("n")), "ends")
    key = [*path, "__b"]
    eq = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    cut = ends.where("__end > part AND __start <= part").select(*[F.col(c) for c in key], "__start")
    border = placed.join(F.broadcast(cut) if few else cut, eq(placed, cut)).select(*[placed[c] for c in key], "__id", "__t", "n_tokens", "__o", "part", "__start")
    # rows that repeat an id and text share one place in the order: it is a row here, with their number
    places = border.groupBy(*key, "__o").agg(F.count(F.lit(1)).alias("m"), F.first("n_tokens").alias("n"), F.first("part").alias("part"), F.first("__start").alias("__start"))
    run = F.sum(F.col("m") * F.col("n")).over(W.partitionBy(*key).orderBy("__o").rowsBetween(W.unboundedPreceding, 0))
    summed = places.withColumn("__sum", run + F.col("__start"))
    place = F.struct("__b", "__o")
    # the last place that the prefix takes whole (none: the bucket's start), and the next one, of which it may take some rows
    last = summed.groupBy(*path).agg(F.max(F.when(F.col("__sum") <= F.col("part"), place)).alias("__last"), F.min(F.when(F.col("__sum") > F.col("part"), F.struct("__b", "__o", F.floor((F.col("part") - F.col("__sum") + F.col("m") * F.col("n")) / F.greatest(F.col("n"), F.lit(1))).alias("rows")))).alias("__next"))
    cuts = cut.groupBy(*path).agg(F.min("__b").alias("__cut"))
    eqp = lambda a, b: [a[c].eqNullSafe(b[c]) for c in path]
    with_cut = sized.join(cuts, eqp(sized, cuts), "left").select(*[sized[c] for c in path], "budget", "whole", "part", "buckets", "__cut")
    limit = materialize(with_cut.join(last, eqp(with_cut, last), "left").select(*[with_cut[c] for c in path], "budget", "whole", "part", "buckets", "__cut", "__last", "__next"), "limit")
    joined = made.join(F.broadcast(limit) if few else limit, eqp(made, limit)).select(*[limit[c] for c in path], "__row", made["n_tokens"], "__id", "__t", "budget", "whole", "part", "buckets", "__cut", "__last", "__next")
    b = F.floor(point * F.col("buckets"))
    inside = (F.col("__cut").isNull() | (b < F.col("__cut")) | F.coalesce(F.struct(b.alias("__b"), order.alias("__o")) <= F.col("__last"), F.lit(False)))
    more = F.when((F.col("part") > 0) & inside, 1).otherwise(0)
    done = ["__row", "n_tokens", "budget"]
    discard(slim, leaves, sized, ends)
    if limit.where("__next.rows > 0").isEmpty():
        out = joined.select(*done, (F.col("whole") + more).cast("long").alias("copies"))
    else:
        tied = F.coalesce((F.col("__next.rows") > 0) & (b == F.col("__next.__b")) & (order == F.col("__next.__o")), F.lit(False))
        out = joined.where(~tied).select(*done, (F.col("whole") + more).cast("long").alias("copies")).unionByName(_some(joined.where(tied).select(*path, *done, "whole", F.col("__next.rows").alias("take")), path).select(*done, "copies"))
    return out.withColumn("leaf_budget", F.col("budget")).where("copies > 0").select("__row.*", "n_tokens", "copies", "leaf_budget")


def _some(rows: DataFrame, path: list[str]) -> DataFrame:
    """rows with copies: one more than ``whole`` for ``take`` of the rows of each leaf, which are all alike.

    They are counted by groups of about BUCKET_ROWS first, so that no task numbers all rows of a leaf.
    """
    tied = materialize(rows.withColumn("__g", F.shiftright(F.monotonically_increasing_id(), 33) * 1024 + F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / BUCKET_ROWS)), "tied")
    upto = W.partitionBy(*path).orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    before = tied.groupBy(*path, "__g").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"b{c}") for c in [*path, "__g"]], "__before")
    same = [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in [*path, "__g"]]
    placed = tied.join(before, same).select(*tied.columns, "__before")
    number = F.row_number().over(W.partitionBy(*path, "__g").orderBy("n_tokens")) + F.col("__before")
    return placed.withColumn("copies", (F.col("whole") + F.when(number <= F.col("take"), 1).otherwise(0)).cast("long"))


def tree() -> dict[str, Column]:
    """Domain (sources in threes), language, source of the documents table."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 3, F.lit(0))
    return {"domain": F.concat(F.lit("domain"), number), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = mix(table(spark, sf_dir, "documents"), tree(), 0.5, {("domain0",): 2.0, ("domain1", "en"): 3.0}, seed=1)
    return out.select("doc_id", "lang", "source", "n_tokens", "copies", F.round("leaf_budget", 3).alias("leaf_budget"))
