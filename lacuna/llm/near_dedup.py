"""Near-duplicates: a chosen-path join of shingle sets under Jaccard similarity.

1. One pass turns each text into the size and a hash of its set of word
   shingles, and ``POOL`` minwise tokens. Equal sets form a class
   (aggregated before the shuffle). The sets aren't kept: texts are smaller,
   and only candidates need theirs again.
2. In each of ``TREES`` trees a class goes to the node of its first ``DEPTH``
   tokens. Nodes with more than ``SMALL`` members branch on by further tokens,
   down to ``DEEPEST``.
3. Each class is compared with the hub of its nodes, the smallest member, that
   it shares most nodes with. Links spread to components.
4. Leaves whose members are in several components are compared exhaustively:
   first the tokens, in cells of about 2 * ``BLOCK`` members; then
   those with a likely partner meet with their full sets, and a product of
   their incidence matrix with itself gives all intersections at once. Tasks
   return each member with the smallest that links reach, never the pairs. What lies outside
   the largest component of a leaf meets all of it; a leaf is cut into blocks,
   so that any number of members is compared, none left out. That work grows
   with the square of such members where a crowd is alike but not linked.

A pair of similarity 0.8 shares ``DEPTH`` tokens in a tree with chance 0.51, so
24 trees miss it with chance 3e-8; in leaves at the deepest level 7e-5.
It agrees in under ``AGREE`` of the tokens with chance 1e-8.

Cases: null and empty texts, and texts without words, have empty sets and are
linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows give a row each; several texts of one id are a document each;
rows of null ids take no part and have a null component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, materialize, runs, table

TREES, DEPTH, DEEPEST, POOL, SMALL, BLOCK, AGREE = 24, 3, 5, 128, 64, 1024, 0.6
#: A hub's members that meet one copy of its text.
STAR = 4096
#: Nodes that a class must share with a hub to be compared with it at once; all others meet in the leaves.
COMMON = 3
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SEED = np.random.default_rng(20240521)
_ODD = _SEED.integers(1, 1 << 63, POOL, dtype=np.uint64) | np.uint64(1)
_PLACE = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: The tokens that each tree takes, in turn.
_ORDER = [_SEED.permutation(POOL)[:DEEPEST].tolist() for _ in range(TREES)]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    words = np.fromiter(map(hashed, found), np.uint64, len(found))
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        total = (total ^ (total >> np.uint64(32))) * _PLACE[k % 64] + words[k : k + n]
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total ^ (total >> np.uint64(32)))


def tokens(held: np.ndarray) -> np.ndarray:
    """The smallest member under each of POOL orders, as 32 bits."""
    low = np.empty(POOL, np.uint64)
    step = max(1, (1 << 18) // max(1, len(held)))
    for i in range(0, POOL, step):
        low[i : i + step] = (held[None, :] * _ODD[i : i + step, None]).min(axis=1)
    return (low ^ (low >> np.uint64(32))).astype(np.uint32)


def _sets(width: int):
    kinds = pa.schema([("n_shingles", pa.int64()), ("class_id", pa.binary()), ("sig", pa.binary()), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                held = shingle_hashes(text, width)
                low = tokens(held) if len(held) else None
                rows.append((len(held), xxhash.xxh3_128_digest(held.tobytes()), low.tobytes(), low.astype(np.uint8).tobytes()) if len(held) else (0, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)]], names=["doc_id", "h", *kinds.names])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stars(width: int, percent: int):
    """Rows sorted by (hub, salt, member): the hub's text comes first, then each member's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            a, b = [], []
            for key, salt, member, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text"))):
                if member is None:
                    at, hub = (key, salt), shingle_hashes(text, width)
                elif at == (key, salt) and _similar(hub, shingle_hashes(text, width), percent):
                    a.append(key)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _crowds(percent: int):
    """Lists of the members of a cell that likely links hold together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs("cell", batches):
            keys, first = np.unique(rows.column("key").to_numpy(), return_index=True)
            size, label = (rows.column(c).to_numpy()[first] for c in ("size", "label"))
            low = np.frombuffer(b"".join(rows.column("tail").to_pylist()), np.uint8).reshape(rows.num_rows, -1)[first]
            near = np.array([(low == x).sum(axis=1, dtype=np.int32) >= AGREE * POOL for x in low])
            near &= 100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)
            near &= label[:, None] != label[None, :]
            left = near.any(axis=1)
            while left.any():
                group = np.zeros(len(keys), bool)
                edge = np.zeros(len(keys), bool)
                edge[np.flatnonzero(left)[0]] = True
                while edge.any():
                    group |= edge
                    edge = near[edge].any(axis=0) & ~group
                left &= ~group
                out.append(keys[group].tolist())
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["members"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["members"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of the incidence matrix, over columns that several sets hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    kept = count[column] > 1
    place = np.cumsum(count > 1) - 1
    column, owner = place[column[kept]], owner[kept]
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(1, (1 << 22) // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)  # whole numbers below 2^24 are exact
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def _links(width: int, percent: int):
    """Which members of each group links hold together: (smallest, member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs("gid", batches):
            keys, first = np.unique(rows.column("key").to_numpy(), return_index=True)
            text = rows.column("text")
            sets = [shingle_hashes(text[int(i)].as_py(), width) for i in first]
            size = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            a, b = [], []
            new = np.ones(len(keys), bool)
            while new.any():
                root = i = int(np.flatnonzero(new)[0])
                new[i] = False
                queue = [i]
                while queue:
                    i = queue.pop()
                    for j in np.flatnonzero(linked[i] & new).tolist():
                        new[j] = False
                        queue.append(j)
                        a.append(int(keys[root]))
                        b.append(int(keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key reachable, for keys with a link."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "edges")
    label = materialize(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "label")
    while True:
        near = both.join(label.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        jump = label.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = label.join(near, "key").withColumn("low", F.least("label", "near")).join(jump, "label").select("key", F.least("low", "far").alias("new"), "label")
        new = materialize(new, "label")
        discard(label)
        moved = not new.where("new < label").isEmpty()
        label = new.select("key", F.col("new").alias("label"))
        label._scratch = new._scratch
        if not moved:
            discard(both)
            return label


def _token(at: Column) -> Column:
    return F.substring("sig", 4 * at + 1, F.lit(4))


def _pick(tree: Column, level: int) -> Column:
    """A tree's token of a level."""
    return _token(F.element_at(F.array(*[F.lit(o[level]) for o in _ORDER]), tree + 1))


def _shared(at: DataFrame, tag: str) -> DataFrame:
    """The rows of nodes with several members, with their number and the hub."""
    count = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub")).where("n > 1")
    return materialize(at.join(count, "node"), tag)


def _leaves(classes: DataFrame, top: DataFrame) -> DataFrame:
    """(node, key) of the leaves: nodes of at most SMALL members, or at the deepest level."""
    now, parts, done = top, [], []
    for d in range(DEPTH, DEEPEST):
        parts.append(now.where(F.col("n") <= SMALL).select("node", "key"))
        big = now.where(F.col("n") > SMALL).select("node", "key", "tree")
        if big.isEmpty():
            break
        now = _shared(big.join(classes.select("key", "sig"), "key").select("key", "tree", F.xxhash64("node", _pick(F.col("tree"), d)).alias("node")), "nodes")
        done.append(now)
    else:
        parts.append(now.select("node", "key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = materialize(out, "leaves")
    discard(*done)
    return out


def _cells(leaves: DataFrame, label: DataFrame) -> DataFrame:
    """(cell, key, label): leaves of several components, cut into blocks."""
    known = leaves.join(label, "key", "left").select("node", "key", F.coalesce("label", "key").alias("label"))
    parts = known.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    size = parts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    size = size.select("node", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("high"))
    mixed = known.join(size, "node").withColumn("few", F.col("label") != F.col("main"))
    row = F.pmod(F.xxhash64("key", F.lit(1)), F.col("high"))
    column = F.pmod(F.xxhash64("key", F.lit(2)), F.col("wide"))
    across = F.when(F.col("few"), F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.xxhash64("node", row, j.cast("long")))).otherwise(F.array().cast("array<bigint>"))
    down = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: F.xxhash64("node", i.cast("long"), column))
    return mixed.select(F.explode(F.array_union(across, down)).alias("cell"), "key", "label")


def _slim(more: DataFrame, label: DataFrame) -> DataFrame:
    """The same connections between components: an edge for each, and one between any two that it had edges to."""
    ends = more.distinct()
    for c in "ab":
        ends = ends.join(label.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(c, F.coalesce(f"l{c}", c)).drop(f"l{c}")
    ends = materialize(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ends")
    low = ends.groupBy("b").agg(F.min("a").alias("low"))
    out = materialize(ends.join(low, "b").select(F.col("low").alias("a"), F.col("a").alias("b")).where("a < b").union(low.select(F.col("low").alias("a"), "b")).distinct(), "slim")
    discard(more, ends)
    return out


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    base = materialize(rows.mapInArrow(_sets(width), "doc_id long, h long, n_shingles long, class_id binary, sig binary, tail binary"), "sets")
    first = base.where("class_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct("doc_id", "h", F.col("n_shingles").alias("size"), "sig", "tail")).alias("m"))
    classes = materialize(first.select(F.monotonically_increasing_id().alias("key"), "class_id", F.col("m.doc_id").alias("rep"), "m.h", "m.size", "m.sig", "m.tail"), "classes")

    nodes = F.array(*[F.xxhash64(F.lit(t), *[_token(F.lit(p)) for p in o[:DEPTH]]) for t, o in enumerate(_ORDER)])
    top = _shared(classes.select("key", F.posexplode(nodes).alias("tree", "node")), "top")
    star = top.where("key <> hub").groupBy("hub", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON)
    best = star.groupBy("key").agg(F.max(F.struct("c", (-F.col("hub")).alias("hub"))).alias("m"))
    pairs = materialize(best.select((-F.col("m.hub")).alias("a"), F.col("key").alias("b")), "pairs")
    leaves = _leaves(classes, top)
    discard(top)

    # the texts of all classes in leaves, shuffled once
    need = leaves.select("key").distinct().join(classes.select("key", F.col("rep").alias("doc_id"), "h"), "key")
    texts = materialize(rows.join(need, ["doc_id", "h"]).select("key", "text"), "candidates")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    member = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    member = member.join(texts.select(F.col("key").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    hub = hubs.join(texts.select(F.col("key").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    dealt = hub.union(member).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = materialize(dealt.mapInArrow(_stars(width, percent), "a long, b long"), "star")
    label = components(links)

    tail = classes.select("key", "size", "tail")
    cells = materialize(_cells(leaves, label).join(tail, "key").repartition("cell").sortWithinPartitions("cell").mapInArrow(_crowds(percent), "members array<bigint>").distinct(), "crowds")
    if not cells.isEmpty():
        group = cells.select(F.xxhash64("members").alias("gid"), F.explode("members").alias("key")).join(texts, "key")
        more = materialize(group.repartition("gid").sortWithinPartitions("gid").mapInArrow(_links(width, percent), "a long, b long"), "links")
        more = _slim(more, label)
    else:
        more = materialize(pairs.limit(0), "links")
    joined = components(more)
    discard(cells, leaves, texts, links, pairs, more)

    whole = classes.select("key", "class_id", "rep").join(label, "key", "left").select("class_id", "rep", F.coalesce("label", "key").alias("key"))
    whole = whole.join(joined, "key", "left").select("class_id", "rep", F.coalesce("label", "key").alias("label"))
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = materialize(whole.join(least, "label").select("class_id", "component_id"), "components")
    discard(classes, label, joined)
    held = base.select("doc_id", "n_shingles", "class_id").join(found, "class_id", "left")
    return held.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
