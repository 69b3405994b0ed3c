"""Exact dedup by minimal perfect hashes over the distinct digests of a history.

The history's digests are cut into shards by their first bits. A shard's hash
function is built level by level: a level is a bit table, a digest that is alone
on its bit stays there, all others go on to the next level; a digest's slot is
the rank of its bit. A slot holds the full digest and the locator of the text
that stays (its length, id and row), so that a lookup compares all 32 bytes: a
member merges into its slot, a digest that is no member is a group of its own.

Rows of one text are counted before any shuffle of theirs, so that a shard sees
a digest once from the history and once from the rest, and streams the latter
past its table: a task holds one shard's slots, about SHARD_KEYS. Groups go back
to the rows by a join on the digest; the fewer than HOT groups with more than
1 / HOT of all rows each are broadcast instead.

Cases: a null text counts as empty; a null id comes after all others, and texts
of equal length and id tie, one row of which stays; an empty table gives an empty
result, an empty history leaves all digests nonmembers; other columns are
ignored by ``groups_of`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Digests of the history that a shard holds, about, and the bits of a level for each digest that reaches it.
SHARD_KEYS = 1 << 17
BITS = 2.0
#: There are fewer groups than this with more than 1 / HOT of all rows.
HOT = 1000
SPACE = " \t\n\x0b\x0c\r"
LOCATOR = "points long, unknown boolean, id long, row long, n long"
INDEX = f"shard int, bits binary, sizes array<int>, digests binary, {LOCATOR.replace('long', 'array<long>').replace('boolean', 'array<boolean>')}"
FIELDS = ("points", "unknown", "id", "row", "n")


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit of a level's table for each digest, from all 256 bits of it."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i in range(4):
        h = _mixed(h ^ words[:, i])
    return (h % np.uint64(size)).astype(np.int64)


def words_of(digests: list[bytes] | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(digests), np.uint8) if isinstance(digests, list) else digests
    return raw.reshape(-1, 32).view("<u8")


class MinimalHash:
    """A bijection of n distinct digests to 0, ..., n - 1; any other digest gets a slot of one of them, or none (-1)."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, words: np.ndarray) -> MinimalHash:
        left, levels = np.arange(len(words)), []
        while len(left):
            at = _places(words[left], len(levels), size := max(8, int(BITS * len(left))))
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), [len(x) for x in levels])

    def slots(self, words: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = _places(words[left], level, size) + start
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + size
        return out


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(text, SPACE, ""), 256))


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row's id, digest of the text without white space, and length. Ids are whole numbers or null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), _digest(text).alias("digest"), F.length(text).cast("long").alias("points"))


def _best(rows: DataFrame) -> DataFrame:
    """One row for each digest: the number of its rows and the locator of the one that stays."""
    order = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0)).alias("id"), "row")
    best = rows.groupBy("digest").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select("digest", (-F.col("b.less")).alias("points"), "b.unknown", "b.id", "b.row", "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def build(history: DataFrame, shards: int) -> DataFrame:
    """The index of the rows of ``keyed`` (with ``row``): one row for each shard, with its hash function and its slots."""

    def one(rows: pa.Table) -> pa.Table:
        digests = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        hashed = MinimalHash.build(words := words_of(digests))
        at = np.argsort(hashed.slots(words))
        cells = {c: [rows[c].take(pa.array(at)).to_pylist()] for c in FIELDS}
        made = {"shard": [rows["shard"][0].as_py()], "bits": [np.packbits(hashed.bits).tobytes()], "sizes": [hashed.sizes], "digests": [digests[at].tobytes()], **cells}
        types = {"shard": pa.int32(), "bits": pa.binary(), "sizes": pa.list_(pa.int32()), "digests": pa.binary(), "unknown": pa.list_(pa.bool_())}
        return pa.table({c: pa.array(v, types.get(c, pa.list_(pa.int64()))) for c, v in made.items()})

    return _best(history).select(_shard(shards), "*").groupBy("shard").applyInArrow(one, INDEX)


def _before(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether locator a stays rather than b: the longer text, known ids first, smaller ones first."""
    out = a[3] < b[3]
    for x, y in ((a[2], b[2]), (a[1], b[1]), (-a[0], -b[0])):
        out = (x < y) | ((x == y) & out)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


class _Slots:
    """One shard: its hash function, digests and locators, and which slots were met."""

    def __init__(self, row: dict):
        n = int(sum(row["sizes"]))
        self.hash = MinimalHash(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=n).astype(bool), row["sizes"])
        self.digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        self.cells = [np.array(row[c], np.int64) for c in FIELDS]
        self.met = np.zeros(len(self.digests), bool)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each member, -1 for others: every byte of the digest is compared."""
        slots = self.hash.slots(words_of(digests))
        held = slots >= 0
        held[held] = (self.digests[slots[held]] == digests[held]).all(axis=1)
        return np.where(held, slots, -1)


def _out(digests: np.ndarray, cells: list[np.ndarray], member: np.ndarray) -> pa.RecordBatch:
    flat = pa.array([x.tobytes() for x in digests], pa.binary())
    id_ = pa.array(cells[2], mask=cells[1].astype(bool))
    return pa.record_batch([flat, id_, pa.array(cells[3]), pa.array(cells[4]), pa.array(member)], ["digest", "keep_id", "keep_row", "group_size", "member"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a partition; its rows are sorted by shard, each shard's slots come first."""
    held, shard = None, None

    def rest() -> Iterator[pa.RecordBatch]:
        if held is not None and not held.met.all():
            new = ~held.met
            yield _out(held.digests[new], [c[new] for c in held.cells], np.ones(new.sum(), bool))

    for batch in batches:
        if not batch.num_rows:
            continue
        index = batch.column("index")
        is_index = index.is_valid().to_numpy(zero_copy_only=False)
        of = _numbers(batch.column("shard"))
        edges = sorted({0, batch.num_rows, *np.flatnonzero(is_index), *(np.flatnonzero(is_index) + 1), *(np.flatnonzero(of[1:] != of[:-1]) + 1)})
        for a, b in zip(edges[:-1], edges[1:]):
            if of[a] != shard:
                yield from rest()
                held, shard = None, of[a]
            if is_index[a]:
                held = _Slots(index[int(a)].as_py())
                continue
            part = batch.slice(a, b - a)
            digests = np.frombuffer(b"".join(part.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            cells = [_numbers(part.column(c)) for c in FIELDS]
            slots = held.lookup(digests) if held is not None else np.full(len(digests), -1)
            member = slots >= 0
            if member.any():
                own, at = [c[member] for c in cells], slots[member]
                theirs = [c[at] for c in held.cells]
                held.met[at] = True
                first = _before(own, theirs)
                both = [np.where(first, x, y) for x, y in zip(own[:4], theirs[:4])] + [own[4] + theirs[4]]
                yield _out(digests[member], both, np.ones(member.sum(), bool))
            if not member.all():
                yield _out(digests[~member], [c[~member] for c in cells], np.zeros((~member).sum(), bool))
    yield from rest()


def lookup(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, keep_row, group_size, member of each distinct text of the history and of ``rows``.

    Members are merged in their slots; what is no member is a group by itself.
    """
    kind = index.select(F.struct("*").alias("index")).schema["index"].dataType
    slots = index.select("shard", F.struct("*").alias("index"), F.lit(None).cast("binary").alias("digest"), *[F.lit(None).cast("boolean" if c == "unknown" else "long").alias(c) for c in FIELDS])
    asked = _best(rows).select(_shard(shards), F.lit(None).cast(kind).alias("index"), "digest", *FIELDS)
    dealt = slots.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("index").isNull())
    return dealt.mapInArrow(_merged, "digest binary, keep_id long, keep_row long, group_size long, member boolean")


def groups_of(docs: DataFrame, history: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each of ``docs``: id, digest, keep_id, group_size, kept.

    history: which rows (of ``id``) are the history; by default those with ids up to the middle of their range.
    """
    spark = docs.sparkSession
    # the number of a row is written with it, so that it stays the same whenever rows are read
    rows = materialize(keyed(docs, text_col, id_col).withColumn("row", F.monotonically_increasing_id()), "keyed")
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if history is None:
        history = F.col("id") <= ((low or 0) + (high or 0)) // 2
    history = F.coalesce(history, F.lit(False))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_KEYS))
    index = materialize(build(rows.where(history), shards), "slots")
    groups = materialize(lookup(index, rows.where(~history), shards), "groups")
    discard(index)
    large = F.col("group_size") > total / HOT
    hot, cold = groups.where(large), groups.where(~large)
    few = rows.join(F.broadcast(hot), "digest")
    many = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    return few.unionByName(many).select("id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def deduplicate(docs: DataFrame, history: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text."""
    kept = groups_of(docs, history, text_col, id_col).where("kept").select(F.col("id").alias("i"), F.col("digest").alias("d"))
    whole = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    text = F.coalesce(F.col("__text").cast("string"), F.lit(""))
    own = whole.select("__row", F.col("__id").cast("long").alias("__id"), _digest(text).alias("__digest"), F.length(text).alias("__points"))
    found = own.join(kept, own["__id"].eqNullSafe(kept["i"]) & (own["__digest"] == kept["d"]), "left_semi")
    # rows of one id and text: the longest of them
    return found.groupBy("__digest").agg(F.max_by("__row", "__points").alias("__row")).select("__row.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = groups_of(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The same rows in SQL; ids are unique there.
SQL = r"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
d AS (SELECT doc_id, LENGTH(text) AS points, SHA256(REGEXP_REPLACE(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
g AS (SELECT *, FIRST_VALUE(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, COUNT(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
