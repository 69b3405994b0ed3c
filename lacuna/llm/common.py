"""Helpers that several operators share: tables, scratch storage, Arrow blocks."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one block of rows may hold before the next block begins.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session on one machine; on
    a cluster it would end up on each executor's own disk, so that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.conf.get("lacuna.scratch.dir", None)
        if not own:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            own = "file://" + tempfile.mkdtemp(prefix="lacuna-")
            spark.conf.set("lacuna.scratch.dir", own)
    return own.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage and survives the loss of executors: the files are
    on shared storage, not on an executor. ``discard`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacuna-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark remove what was shuffled for tables that are written by now.

    It does so when the driver's JVM has collected their plans, which listeners
    may hold a little longer than the job.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.java.lang.System.gc()
        time.sleep(0.3)


def runs(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``key`` as one batch; the rows must be sorted by it.

    For keys of a bounded number of rows: a run is held whole.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(k)]
        if held and held[-1].column(key)[0].as_py() != batch.column(key)[0].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, b in zip(edges[:-2], edges[1:-1]):
            part = batch.slice(a, b - a)
            yield pa.Table.from_batches([*held, part]).combine_chunks().to_batches()[0] if held else part
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of df to be; for files, their size; 0 where it can't tell."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches into slices of at most ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array laid end to end, and the n + 1 offsets; nulls are empty."""
    kind = pa.large_binary()
    flat = pc.fill_null(column.cast(pa.large_string()) if pa.types.is_string(column.type) else column, "" if not pa.types.is_binary(column.type) else b"").cast(kind)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, lengths)
