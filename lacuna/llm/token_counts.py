"""Token counts: pieces are counted once per distinct pre-token.

1. Each block of documents is cut into pre-tokens by the vocabulary's own
   normaliser and pre-tokeniser. A block keeps, per document, the frequencies
   of its distinct pre-tokens (as a packed list) and its list of distinct
   pre-tokens, dealt into buckets by a hash of the pre-token.
2. Each bucket holds every block's slice of the same pre-tokens. A pre-token is
   run through the merges once there, and the piece counts go back to the block.
3. A block joins the piece counts to its frequencies and sums them per document.
   No list of token ids is ever made.

A frequent pre-token has one entry per block, not one per document, so no
bucket grows with its frequency; the number of buckets follows the number of
distinct entries.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and null
ids keep a row each; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, estimated_bytes, materialize, ranges

#: Bytes of input for each bucket of pre-tokens.
BUCKET_BYTES = 16 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of uint32, one byte plane after another, compressed."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        z = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(struct.pack("<II", len(a), len(z)) + z)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        length, size = struct.unpack_from("<II", data, at)
        at += 8
        planes = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, 4 * length))
        out.append(np.frombuffer(planes, np.uint8).reshape(4, length).T.copy().view("<u4").ravel().astype(np.int64))
        at += size
    return out


class PreTokens:
    """Splits a chunk of text without ASCII white space into pre-tokens.

    The units are the byte-level strings that the merges start from. A chunk
    that holds a special token's string is a unit of its own, marked by a
    leading space, and is counted by the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.norm = self.tok.normalizer.normalize_str if self.tok.normalizer else str
        self.pre = self.tok.pre_tokenizer.pre_tokenize_str

    def units(self, chunk: str) -> list[str]:
        if any(s in chunk for s in self.special):
            return [" " + chunk]
        return [piece for piece, _ in self.pre(self.norm(chunk))]

    def pieces(self, unit: str) -> int:
        if unit.startswith(" "):
            return len(self.tok.encode(unit[1:], add_special_tokens=False).ids)
        return len(self.tok.model.tokenize(unit))


def _frequencies(path: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(path)
        part, k = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", 2 * BLOCK_BYTES):
            text = pc.fill_null(batch.column("text"), "")
            words = pc.ascii_split_whitespace(text)
            coded = words.flatten().dictionary_encode()
            chunk = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            per_doc = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            # frequencies of distinct chunks in each document
            n_chunks = max(1, len(coded.dictionary))
            key, freq = np.unique(np.repeat(np.arange(len(per_doc)), per_doc) * n_chunks + chunk, return_counts=True)
            doc, chunk = key // n_chunks, key % n_chunks
            # the pre-tokens of each distinct chunk
            ids: dict[str, int] = {}
            flat: list[int] = []
            size = np.zeros(n_chunks, np.int64)
            for i, c in enumerate(coded.dictionary.to_pylist()):
                found = split.units(c)
                size[i] = len(found)
                flat += [ids.setdefault(u, len(ids)) for u in found]
            begin = np.cumsum(size) - size
            units = np.asarray(flat, np.int64)[ranges(begin[chunk], size[chunk])]
            n_units = max(1, len(ids))
            key, at = np.unique(np.repeat(doc, size[chunk]) * n_units + units, return_inverse=True)
            freq = np.bincount(at, np.repeat(freq, size[chunk]), len(key)).astype(np.int64)
            doc, unit = key // n_units, key % n_units
            # renumber pre-tokens bucket by bucket, so that a bucket's counts are a slice
            names = np.array(list(ids), dtype=object)
            bucket = np.fromiter((xxhash.xxh32_intdigest(u) % n_buckets for u in ids), np.int64, len(ids))
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            unit = rank[unit] if len(unit) else unit
            o = np.lexsort((unit, doc))
            doc, unit, freq = doc[o], unit[o], freq[o]
            step = np.diff(unit, prepend=0)
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            step[cut] = unit[cut]
            held = np.bincount(doc, minlength=len(per_doc))
            parts = np.bincount(bucket, minlength=n_buckets)
            ends = np.cumsum(parts)
            slices = [
                {"bucket": int(b), "units": names[order[ends[b] - parts[b] : ends[b]]].tolist()} for b in np.flatnonzero(parts)
            ]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (part << 32) + k,
                        "ids": batch.column("id").to_pylist(),
                        "n_bytes": pc.binary_length(text.cast(pa.binary())).to_pylist(),
                        "freqs": _pack(held, step, freq),
                        "slices": slices,
                    }
                ],
                schema=_BLOCK,
            )
            k += 1

    return run


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
        ("freqs", pa.binary()),
        ("slices", pa.list_(pa.struct([("bucket", pa.int32()), ("units", pa.list_(pa.string()))]))),
    ]
)


def _count(path: str):
    def run(group: pa.Table) -> pa.Table:
        split = PreTokens(path)
        group = group.combine_chunks()
        units = group.column("units").combine_chunks()
        units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
        coded = units.flatten().dictionary_encode()
        pieces = np.fromiter(map(split.pieces, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        counts = pieces[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else pieces
        ends = np.cumsum(pc.list_value_length(units).to_numpy(zero_copy_only=False))
        packed = [_pack(c) for c in np.split(counts, ends[:-1])]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "pieces": pa.array(packed, pa.binary())})

    return run


def _sum(limit: int, id_col: str):
    out = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, step, freq = _unpack(row["freqs"])
                found = sorted(row["counts"] or [], key=lambda c: c["bucket"])
                pieces = np.concatenate([_unpack(c["pieces"])[0] for c in found]) if found else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(held)), held)
                total = np.cumsum(step)
                some = held > 0
                first = (np.cumsum(held) - held)[some]
                unit = total - np.repeat(total[first] - step[first], held[some])
                n = np.bincount(doc, freq * pieces[unit], len(held)).astype(np.int64) if len(unit) else np.zeros(len(held), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(n), pa.array(n > limit)], schema=out)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """Bytes and tokens of each text; over_limit where there are more than ``limit`` tokens.

    path: a tokenizer file of the tokenizers library, readable on each executor.
    """
    spark = docs.sparkSession
    if n_buckets is None:
        n_buckets = max(16, 2 * spark.sparkContext.defaultParallelism, estimated_bytes(docs) // BUCKET_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(
        rows.mapInArrow(
            _frequencies(path, n_buckets),
            "block long, ids array<long>, n_bytes array<long>, freqs binary, slices array<struct<bucket:int, units:array<string>>>",
        ),
        "freqs",
    )
    counts = (
        made.select("block", F.explode("slices").alias("s"))
        .select("block", "s.bucket", "s.units")
        .groupBy("bucket")
        .applyInArrow(_count(path), "block long, bucket int, pieces binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "pieces")).alias("counts"))
    )
    return (
        made.select("block", "ids", "n_bytes", "freqs")
        .join(counts, "block", "left")
        .select("ids", "n_bytes", "freqs", "counts")
        .mapInArrow(_sum(limit, id_col), f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
    )


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
