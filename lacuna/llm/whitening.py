"""Whitening of embeddings by streamed moments and a symmetric QR eigen-solve.

Vectors become whole numbers x = floor(SCALE * c) + OFFSET; each distinct x counts
once. Every partition streams its vectors through Welford's update: a vector
moves the mean and adds the product of its distances to the mean before and after
as a rank-one update; the updates of a batch are taken as one matrix product.
The states of partitions, of d * d numbers each, are merged by the parallel
formula, FAN of them in a task, round by round, until one is left. The
covariance (d * d, whatever the number of rows) is reduced to a tridiagonal
matrix by reflections and diagonalised by implicit QR steps.

Cases: rows whose vector is null, empty, or holds null or non-finite components
are dropped; null ids and repeated rows stay; vectors of different lengths are
an error, as is a sum of squares beyond the range of long; equal eigenvalues
come in any order; components without variance can't be whitened and give no
row, so that vectors that are all alike give none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: States that one task merges.
FAN = 32
#: Rows whose rank-one updates are one product.
BATCH = 4096
#: An eigenvalue below this share of the largest is rounding.
FLAT = 1e-12
STATE = "dims int, n long, sums array<long>, mean binary, square binary"


class Moments:
    """n vectors' mean, sum of outer products about it, and exact sums of whole numbers."""

    def __init__(self, dims: int):
        self.n, self.mean, self.square, self.sums = 0, np.zeros(dims), np.zeros((dims, dims)), np.zeros(dims, np.int64)

    def add(self, rows: np.ndarray) -> None:
        """Welford's update for each row in turn: square += (x - mean before)(x - mean after)'."""
        x = rows.astype(np.float64) - self.mean
        counts = self.n + np.arange(1, len(x) + 1)[:, None]
        after = np.cumsum(x, axis=0) / counts  # of the mean, relative to the one at the start
        before = np.vstack([np.zeros(x.shape[1]), after[:-1]])
        step = (x - before).T @ (x - after)
        self.square += (step + step.T) / 2
        self.mean = self.mean + after[-1]
        self.n += len(x)
        if rows.dtype.kind == "i":
            self.sums = self.sums + rows.sum(axis=0)

    def merge(self, other: Moments) -> None:
        """The parallel formula for two disjoint sets of rows."""
        if not other.n:
            return
        n, gap = self.n + other.n, other.mean - self.mean
        self.square = self.square + other.square + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean = self.mean + gap * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self) -> pa.RecordBatch:
        d = len(self.mean)
        cells = [pa.array([d], pa.int32()), pa.array([self.n]), pa.array([self.sums.tolist()], pa.list_(pa.int64())), pa.array([self.mean.tobytes()]), pa.array([self.square.tobytes()])]
        return pa.record_batch(cells, ["dims", "n", "sums", "mean", "square"])

    @classmethod
    def of(cls, row: dict) -> Moments:
        out = cls(d := row["dims"])
        out.n, out.sums = row["n"], np.array(row["sums"], np.int64)
        out.mean, out.square = np.frombuffer(row["mean"]), np.frombuffer(row["square"]).reshape(d, d)
        return out


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """The vectors of a list column as rows; ValueError if they differ in length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(column) or (column.value_lengths().to_numpy() != len(flat) // len(column)).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def moments(df: DataFrame, column: str) -> Moments | None:
    """Mean, covariance sums and exact sums of a column of equally long vectors; None without rows."""
    kind = np.int64 if df.schema[column].dataType.elementType.simpleString() == "bigint" else np.float64

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0).slice(a, BATCH), kind)
                state = state or Moments(x.shape[1])
                if x.shape[1] != len(state.mean):
                    raise ValueError("vectors differ in length")
                state.add(x)
        if state:
            yield state.row()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.select(["dims", "n", "sums", "mean", "square"]).to_pylist():
                if row["dims"] in held:
                    held[row["dims"]].merge(Moments.of(row))
                else:
                    held[row["dims"]] = Moments.of(row)
        if len(held) > 1:
            raise ValueError("vectors differ in length")
        for state in held.values():
            yield state.row()

    states = materialize(df.select(column).mapInArrow(own, STATE), "moments")
    while (n := states.count()) > FAN:
        fewer = materialize(states.repartition(-(-n // FAN)).mapInArrow(several, STATE), "moments")
        discard(states)
        states = fewer
    last = materialize(states.coalesce(1).mapInArrow(several, STATE), "moments")
    row = last.first()
    discard(states, last)
    return Moments.of(row.asDict()) if row else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal q with a = q t q', by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, by QR steps with implicit shifts on the tridiagonal form."""
    d, e, q = tridiagonal(np.asarray(a, np.float64))
    v = np.ascontiguousarray(q.T)  # an eigenvector is a row meanwhile
    low, high = 0, len(d) - 1
    while high > 0:
        small = np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= small] = 0.0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half if half else 1.0))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, w, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * w + s * s * t, s * s * p - 2 * c * s * w + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * w
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            v[k], v[k + 1] = c * v[k] + s * v[k + 1], c * v[k + 1] - s * v[k]
    order = np.argsort(-d, kind="stable")
    return d[order], v[order].T


def whole_numbers(vec: Column) -> Column:
    """x of each component; null where the vector takes no part."""
    fine = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(vec, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(OFFSET).cast("long"))
    return F.when(F.coalesce(fine & (F.size(vec) > 0), F.lit(False)), x)


class Whitening:
    """Fitted on the distinct vectors of a column of whole numbers; ``apply`` adds no pass but its own."""

    def __init__(self, components: int = COMPONENTS):
        self.components = components

    def fit(self, rows: DataFrame, column: str = "x") -> Whitening:
        fit = materialize(rows.select(column).distinct(), "fit")
        try:
            state = moments(fit, column)
            self.n, self.kept, self.identity_error = 0, 0, 0.0
            if state is None:
                return self
            self.n, self.sums = state.n, state.sums
            values, vectors = symmetric_qr(state.square / state.n)
            self.kept = int((values[: self.components] > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
            self.explained = values[: self.kept] / np.trace(state.square / state.n)
            self.turn = vectors[:, : self.kept] / np.sqrt(values[: self.kept])
            if self.kept:
                again = moments(self.scores(fit.select(column), column).select("scores"), "scores")
                self.identity_error = float(np.abs(again.square / again.n - np.eye(self.kept)).max())
        finally:
            discard(fit)
        return self

    def scores(self, rows: DataFrame, column: str = "x") -> DataFrame:
        """rows with scores (whitened components) and deviation (sum of (n * x - sum)^2, exact)."""
        n, sums, turn = self.n, self.sums, self.turn
        schema = T.StructType([*rows.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
        at = rows.columns.index(column)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, BATCH):
                    part = batch.slice(a, BATCH)
                    x = _matrix(part.column(at), np.int64)
                    if x.shape[1] != len(sums):
                        raise ValueError("vectors differ in length")
                    gap = n * x - sums
                    deviation = (gap * gap).sum(axis=1)
                    if ((gap.astype(np.float64) ** 2).sum(axis=1) > 9.2e18).any():
                        raise OverflowError("a sum of squares exceeds long")
                    flat = ((gap / n) @ turn).ravel()
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1], flat)
                    yield pa.record_batch([*part.columns, lists, pa.array(deviation)], schema=pa.schema([*part.schema, ("scores", lists.type), ("deviation", pa.int64())]))

        return rows.mapInArrow(one, schema)


def whiten(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = df.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vec_col)).alias("x")).where("x IS NOT NULL")
    model = Whitening(components).fit(rows)
    if not model.kept:
        return df.sparkSession.createDataFrame([], f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = model.scores(rows).select("vec_id", "deviation", F.posexplode("scores").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return whiten(table(spark, sf_dir, "embeddings"))
