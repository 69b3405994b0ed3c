"""Audit of how filters interact, by inclusion and exclusion over joint failures.

One aggregate counts, for every set of filters, the rows that fail all of them:
sums of products of 0/1 flags. Moebius inversion turns these 2^k joint counts of
a part into the survivors of every set of filters, and from these follow, for
any order, what each step keeps and removes, what would have failed anyway, and
what only one filter removes. The dividends of the game "rows removed by a set"
are the joint counts with alternating signs, so the Shapley values need no
orders: a set's dividend is shared among its filters alike.

A copy is a row with a known id above the smallest id of its text. Smallest ids
are counted before the shuffle and joined on (text digest, id), so that one text
in a third of all rows is no hot key; labels are joined on the id.

Cases: a null text counts as empty; a null part is the empty string; rows with a
null id are never copies and have no labels; rows that repeat an id and text are
no copies of each other; of repeated labels one that is 1 is enough; an empty
table gives no part and no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from json import dumps
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def flagged(docs: DataFrame, part: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, part, digest of the text, and a failure flag (0 or 1) for each filter that needs the row alone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    cut = own.select("id", "part", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    sized = cut.select("id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.length("text").alias("points"), F.length(F.translate("text", UPPER, "")).alias("rest"))
    failing = {"A": F.col("n") < 100, "B": 100 * F.col("distinct").cast("long") < 80 * F.col("n").cast("long"), "C": 100 * (F.col("points") - F.col("rest")).cast("long") > 10 * F.col("points").cast("long"), "D": F.col("text").rlike(r"[#$%&*|]")}
    return sized.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.cast("int").alias(f) for f, c in failing.items()])


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with E: 1 where a smaller id has the same text."""
    known = rows.where("id IS NOT NULL")
    first = known.groupBy(F.col("digest").alias("of_text")).agg(F.min("id").alias("first_id"))
    copied = known.join(first, (F.col("digest") == F.col("of_text")) & (F.col("id") == F.col("first_id")), "left").withColumn("E", F.col("first_id").isNull().cast("int"))
    return copied.drop("of_text", "first_id").unionByName(rows.where("id IS NULL").withColumn("E", F.lit(0)))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic: 1 where a label says so."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.where("id IS NOT NULL").join(own, F.col("id") == F.col("l"), "left").drop("l")
    return known.unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})).fillna(0, ["good", "toxic"])


def joint_failures(rows: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, and arrays of 2^k counts: the rows that fail all filters of a set, bit i of the index being filter i; of all rows and of each weight."""
    sets = [[f for i, f in enumerate(filters) if s >> i & 1] for s in range(1 << len(filters))]
    of = lambda s, w: F.sum(reduce(lambda a, b: a * b, [F.col(c).cast("long") for c in s + w], F.lit(1).cast("long")))
    flat = rows.groupBy("part").agg(*[of(s, w).alias(f"{n}{i}") for n, w in (("all", []), *((x, [x]) for x in weights)) for i, s in enumerate(sets)])
    return flat.select("part", *[F.array(*[F.col(f"{n}{i}") for i in range(len(sets))]).alias(n) for n in ("all", *weights)])


def _sign(s: Column) -> Column:
    return 1 - 2 * (F.bit_count(s) % 2)


def survivors(joint: str, k: int) -> Column:
    """Moebius inversion: of each set of filters the rows that fail none of it."""
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    inside = lambda t: F.filter(sets, lambda s: s.bitwiseAND(t) == s)
    return F.transform(sets, lambda t: F.aggregate(inside(t), F.lit(0).cast("long"), lambda a, s: a + _sign(s) * F.get(F.col(joint), s)))


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with COUNTS."""
    k = len(filters)
    steps = [{"filter_order": o, "step": i + 1, "f": filters.index(f), "before": sum(1 << filters.index(x) for x in o[:i])} for o in map("".join, permutations(filters)) for i, f in enumerate(o)]
    orders = F.from_json(F.lit(dumps(steps)), "array<struct<filter_order:string,step:int,f:int,before:int>>")
    # a dividend is shared alike by the filters of its set: in k! orders, each comes first in k! / size
    first_in = F.array(*[F.lit(factorial(k) // max(1, size)).cast("long") for size in range(k + 1)])
    holding = lambda i: F.filter(F.sequence(F.lit(1), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.lit(1 << i)) != 0)
    shares = F.array(*[F.aggregate(holding(i), F.lit(0).cast("long"), lambda a, s: a - _sign(s) * F.get("all", s) * F.get(first_in, F.bit_count(s))) for i in range(k)])
    ready = joint.select("part", "all", *[survivors(c, k).alias(f"s_{c}") for c in ("all", "good", "toxic")], shares.alias("shares"))
    each = ready.select("*", F.inline(orders))
    bit = F.expr("shiftleft(1, f)")
    after, whole = F.col("before").bitwiseOR(bit), F.lit((1 << k) - 1)
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    counts = {
        "kept": F.get("s_all", after), "removed": lost("s_all"), "redundant": F.get("all", bit) - lost("s_all"), "unique_fails": F.get("s_all", whole - bit) - F.get("s_all", whole),
        "good_lost": lost("s_good"), "toxic_lost": lost("s_toxic"), "shapley": F.get("shares", F.col("f")),
    }
    return each.select("part", "filter_order", "step", *[v.cast("long").alias(c) for c, v in counts.items()])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Flags are written once, about 60 bytes a row: the joins read them several times, and texts only once."""
    rows = materialize(flagged(docs, part), "flags")
    return interactions(joint_failures(with_labels(with_copies(rows), labels)))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ROWS = r"""
WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text, COALESCE([x FOR x IN STRING_SPLIT_REGEX(text, '[\x20\x09-\x0D]+') IF x <> ''], []) AS w FROM documents),
l AS (SELECT doc_id, MAX(CAST(quality = 1 AS INTEGER)) AS good, MAX(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.part, COALESCE(l.good, 0) AS good, COALESCE(l.toxic, 0) AS toxic, LEN(w) < 100 AS a, 100 * LEN(LIST_DISTINCT(w)) < 80 * LEN(w) AS b,
  100 * LENGTH(REGEXP_REPLACE(text, '[^A-Z]', '', 'g')) > 10 * LENGTH(text) AS c, REGEXP_MATCHES(text, '[#$%&*|]') AS d, COALESCE(t.doc_id > MIN(t.doc_id) OVER (PARTITION BY text), FALSE) AS e FROM t LEFT JOIN l USING (doc_id)),
p AS (SELECT part, good, toxic, CONCAT(IF(a, 'A', ''), IF(b, 'B', ''), IF(c, 'C', ''), IF(d, 'D', ''), IF(e, 'E', '')) AS fails, COUNT(*) AS n FROM f GROUP BY ALL)
"""
_ORDERS = """
x AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT p1.f || p2.f || p3.f || p4.f || p5.f AS filter_order FROM x p1, x p2, x p3, x p4, x p5 WHERE LEN(LIST_DISTINCT([p1.f, p2.f, p3.f, p4.f, p5.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, (SELECT UNNEST([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, CONTAINS(fails, f) AS own, LEN(earlier) > 0 AND fails <> TRANSLATE(fails, earlier, '') AS gone, fails = f AS alone FROM s, p),
c AS (SELECT part, filter_order, step, f, CAST(SUM(IF(gone OR own, 0, n)) AS BIGINT) AS kept, CAST(SUM(IF(own AND NOT gone, n, 0)) AS BIGINT) AS removed, CAST(SUM(IF(own AND gone, n, 0)) AS BIGINT) AS redundant, CAST(SUM(IF(alone, n, 0)) AS BIGINT) AS unique_fails,
  CAST(SUM(IF(own AND NOT gone, n * good, 0)) AS BIGINT) AS good_lost, CAST(SUM(IF(own AND NOT gone, n * toxic, 0)) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""
#: Every order is applied step by step to the counts of each pattern of failures.
SQL = f"{_ROWS.rstrip()},{_ORDERS}"
