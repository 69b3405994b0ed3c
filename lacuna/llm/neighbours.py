"""Nearest neighbours by a block matrix join with int8 tiles.

Queries go to the tasks in blocks of QUERY_BYTES. A task multiplies int8 tiles
of its rows with the queries; each product has an error bound from the rounding
of both vectors. Pairs whose upper bound reaches a query's k-th best lower bound
are computed again in double precision and pushed on the query's heap. A task
emits each query's heap once; a ranking merges the heaps. The result is exact.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part; a product beyond the range of doubles is infinite, and one of
which parts are infinite either way counts as -inf; vectors of different lengths are never paired; equal scores go by
smaller id; of query rows with one id the first counts; candidates with one id
each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BYTES = 32 << 20
TILE_QUERIES, TILE_ROWS = 256, 4096


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, of any finite components: neither squares that overflow nor such that vanish."""
    top = np.abs(rows).max(axis=1)
    unit = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((rows / unit[:, None]) ** 2).sum(axis=1))


class Rounded:
    """int8 rows with their scale, length, and the length of what rounding left."""

    def __init__(self, rows: np.ndarray):
        self.exact = rows.astype(np.float64)
        # of smaller vectors all codes are 0, and all of them is what rounding left
        self.scale = np.maximum(np.abs(self.exact).max(axis=1) / 127, 1e-300)
        self.codes = np.rint(self.exact / self.scale[:, None]).astype(np.int8)
        back = self.codes * self.scale[:, None]
        with np.errstate(over="ignore"):
            self.norm = lengths(back)
            self.left = lengths(self.exact - back) * (1 + 1e-9)


def tile(q: Rounded, a: int, b: int, c: Rounded) -> tuple[np.ndarray, np.ndarray]:
    """Products of queries a..b with rows, and how far they may be off. float32 holds the integer sums exactly up to 1,000 dimensions."""
    kind = np.float32 if q.codes.shape[1] <= 1000 else np.float64
    near = (q.codes[a:b].astype(kind) @ c.codes.T.astype(kind)).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        near *= q.scale[a:b, None] * c.scale[None, :]
        off = q.left[a:b, None] * (c.norm + c.left)[None, :] + q.norm[a:b, None] * c.left[None, :] + 1e-12
        # sums in double precision are rounded too
        off += 1e-12 * q.norm[a:b, None] * c.norm[None, :]
        unknown = ~(np.isfinite(near) & np.isfinite(off))
    # beyond the range of doubles nothing is known of a pair but by its exact product
    near[unknown], off[unknown] = 0.0, np.inf
    return near, off


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every`` the k rows of largest inner product, but for the query's own."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    asked = base.where(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    parts = 2 * spark.sparkContext.defaultParallelism
    # rows are dealt evenly, so that no task holds a hot group
    dealt = base.repartition(parts)
    found = None
    for block in range(max(1, math.ceil(size / QUERY_BYTES))):
        n = max(1, math.ceil(size / QUERY_BYTES))
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).collect()  # about QUERY_BYTES
        by_dim: dict[int, dict[int, list[float]]] = {}
        for r in rows:
            by_dim.setdefault(len(r.v), {}).setdefault(r.vec_id, r.v)
        sent = spark.sparkContext.broadcast({d: (np.array(list(x)), np.array(list(x.values()))) for d, x in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = {d: (ids, Rounded(rows), [[] for _ in ids]) for d, (ids, rows) in sent.value.items()}
            for batch in batches:
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                vec = batch.column("v")
                dims = vec.value_lengths().to_numpy(zero_copy_only=False)
                for d, (qid, q, heaps) in held.items():
                    at = np.flatnonzero(dims == d)
                    for start in range(0, len(at), TILE_ROWS):
                        some = at[start : start + TILE_ROWS]
                        rows = vec.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                        c = Rounded(rows)
                        for a in range(0, len(qid), TILE_QUERIES):
                            push(q, qid, heaps, a, min(a + TILE_QUERIES, len(qid)), c, ids[some], k)
            for qid, _, heaps in held.values():
                got = [(int(i), -v, s) for i, h in zip(qid, heaps) for s, v in h]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        part = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def push(q: Rounded, qid: np.ndarray, heaps: list[list], a: int, b: int, c: Rounded, ids: np.ndarray, k: int) -> None:
    near, off = tile(q, a, b, c)
    own = qid[a:b, None] == ids[None, :]
    low = np.where(own, -np.inf, near - off)
    floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[a:b]])
    if low.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((near + off >= floor[:, None]) & ~own)
    if not len(i):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        exact = np.einsum("ij,ij->i", q.exact[a + i], c.exact[j])
    exact[np.isnan(exact)] = -np.inf
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, i)
    for x, y, s in zip(*(v[np.arange(len(i)) - first < k].tolist() for v in (i, ids[j], exact))):
        h = heaps[a + x]
        if len(h) < k:
            heapq.heappush(h, (s, -y))
        elif (s, -y) > h[0]:
            heapq.heapreplace(h, (s, -y))


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"))
