"""Benchmark decontamination by an FM-index of each training shard.

A shard is a block of documents. Its words become symbols; words that no test
item has can't be in a window, so they only separate the runs of known words.
The suffix array of the runs gives the Burrows-Wheeler transform, kept in a
wavelet matrix; all windows are searched backwards at once by its ranks.
Occurrences are located by walking to sampled suffix positions, and their words
are merged into spans.

Cases: null and empty texts have no words and no hits; empty items have no
window; repeated rows and null ids keep a row each; items with a null id hit but
are not listed; an empty benchmark or table
gives no hits. Test windows reach the tasks in blocks of ITEM_BYTES, one pass
over a shard for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ranges

WINDOW = 10
#: Text bytes of a shard, and of test items that one index search takes.
SHARD_BYTES, ITEM_BYTES = 8 << 20, 8 << 20
SAMPLE = 8
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class Wavelet:
    """Counts of a symbol before a position, bit by bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(bit, self.zeros[k] + a, low - a), np.where(bit, self.zeros[k] + b, high - b)
        return high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling; symbol 0 is a separator, each smaller than the next one."""
    n = len(symbols)
    gap = symbols == 0
    rank = symbols + int(gap.sum())
    rank[gap] = np.arange(int(gap.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        r = rank[order]
        new = np.concatenate([[True], r[1:] != r[:-1]]) if n else np.zeros(0, bool)
        start = np.flatnonzero(new)
        group = np.zeros(n, np.int64)
        group[order] = start[np.cumsum(new) - 1] if n else start
        rank = group
        size = np.diff(np.append(start, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        at = order[tied]
        follow = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        o = np.lexsort((follow, rank[at]))
        order[tied] = at[o]
        key = rank[at[o]] * (n + 2) + follow[o] + 1
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[at[o]] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        width *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int):
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        self.wavelet = Wavelet(before, max(1, int(size).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))])
        # sampled positions, and the first of each run: a walk never crosses a separator
        self.held = (sa % SAMPLE == 0) | (before == 0)
        self.slot, self.sampled = np.cumsum(self.held) - 1, sa[self.held]
        self.before = before

    def search(self, pattern: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of pattern; rows are filled from the right."""
        lo, hi = np.zeros(len(pattern), np.int64), np.full(len(pattern), len(self.before), np.int64)
        for k in range(pattern.shape[1]):
            on = np.flatnonzero((length > k) & (hi > lo))
            s = pattern[on, -1 - k]
            lo[on], hi[on] = self.first[s] + self.wavelet.rank(s, lo[on]), self.first[s] + self.wavelet.rank(s, hi[on])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        at, steps = row.copy(), np.zeros(len(row), np.int64)
        while True:
            go = np.flatnonzero(~self.held[at])
            if not len(go):
                return self.sampled[self.slot[at]] + steps
            s = self.before[at[go]].astype(np.int64)
            at[go] = self.first[s] + self.wavelet.rank(s, at[go])
            steps[go] += 1


class Windows:
    """Distinct windows of test items as symbol rows, and the numbers of the items that have each, end to end.

    All in arrays: with the dictionary of distinct words about 75 bytes a window, 200 while they are made.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        self.vocab: dict[str, int] = {}
        number = self.vocab.setdefault
        held = [np.array([number(w, len(self.vocab) + 1) for w in words(text)], np.int32) for _, text in items]
        sizes = np.array([len(h) for h in held], np.int64)
        count = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        # a text shorter than a window stands at its right end, after zeros
        flat = np.concatenate([np.zeros(width, np.int32), *[part for h in held for part in (np.zeros(max(0, width - len(h)), np.int32) if len(h) else h, h)]])
        pad = np.where(sizes > 0, np.maximum(0, width - sizes), 0)
        begin = width + np.cumsum(pad + sizes) - (pad + sizes)
        rows = np.lib.stride_tricks.sliding_window_view(flat, width)[ranges(begin, count)]
        pattern, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.pattern, self.length = pattern, (pattern > 0).sum(axis=1)
        self.least = int(self.length.min()) if len(pattern) else 0
        named = np.array([item is not None for item, _ in items], bool)
        owner = np.repeat(np.arange(len(items)), count)
        pairs = np.unique(which.ravel()[named[owner]] * max(1, len(items)) + owner[named[owner]])
        self.owner = pairs % max(1, len(items))
        self.cut = np.searchsorted(pairs // max(1, len(items)), np.arange(len(pattern) + 1))
        self.names = [str(item) for item, _ in items]

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.cut[window] : self.cut[window + 1]].tolist()]


def shard_hits(texts: list[list[str]], windows: Windows) -> tuple[list[np.ndarray], list[set]]:
    """For each document the sorted positions of its hit words and the items that occur."""
    none = [np.zeros(0, np.int64)] * len(texts), [set() for _ in texts]
    if not len(windows.pattern):
        return none
    sizes = np.array([len(t) for t in texts], np.int64)
    get = windows.vocab.get
    flat = np.fromiter((get(w, 0) for t in texts for w in [*t, ""]), np.int64, int(sizes.sum()) + len(texts))
    # runs of known words that are long enough for some window
    edge = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= windows.least
    begin, size = begin[keep], (end - begin)[keep]
    if not len(begin):
        return none
    place = ranges(begin, size + 1)
    symbols = flat[place]
    symbols[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(symbols, len(windows.vocab) + 1)
    lo, hi = index.search(windows.pattern, windows.length)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    if not len(which):
        return none
    start = place[index.locate(ranges(lo, hi - lo))]
    doc_of = np.repeat(np.arange(len(texts)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    marked = np.zeros(len(flat), bool)
    marked[ranges(start, windows.length[which])] = True
    hit = np.flatnonzero(marked)
    cut = np.searchsorted(doc_of[hit], np.arange(len(texts) + 1))
    hits = [hit[cut[i] : cut[i + 1]] - first[i] for i in range(len(texts))]
    items: list[set] = [set() for _ in texts]
    for key in np.unique(doc_of[start] * len(lo) + which):
        items[key // len(lo)].update(windows.items(key % len(lo)))
    return hits, items


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    block, held = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "")
        if held > ITEM_BYTES:
            yield block
            block, held = [], 0
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW) -> DataFrame:
    """One row per document: its columns, n_words, hits (spans of hit words, half-open), items, and clean_text without the words of its spans.

    Columns of docs named like these results are replaced.
    """
    taken = [c for c in docs.columns if c in ("n_words", "hits", "items", "clean_text")]
    base = docs.drop(*taken).withColumn("hits", F.array().cast("array<struct<a:long,b:long>>")).withColumn("items", F.array().cast("array<string>")).withColumn("n_words", F.lit(0).cast("long")).withColumn("clean_text", F.col(text_col).cast("string"))
    schema = base.schema
    out = base
    for block in item_blocks(benchmark, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            windows = Windows(block, width)
            for batch in batches_of(batches, text_col):
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                text = [t or "" for t in col[text_col].cast(pa.string()).to_pylist()]
                split = [words(t) for t in text]
                hits, items = shard_hits(split, windows)
                spans, whole, clean = [], [], []
                for i, (h, old) in enumerate(zip(hits, col["hits"].to_pylist())):
                    if old:
                        h = np.unique(np.concatenate([h, *[np.arange(s["a"], s["b"]) for s in old]]))
                    jump = np.flatnonzero(np.diff(h, prepend=-2) != 1)
                    ends = [*(h[jump[1:] - 1] + 1).tolist(), *([int(h[-1]) + 1] if len(h) else [])]
                    spans.append([{"a": int(h[j]), "b": e} for j, e in zip(jump, ends)])
                    whole.append(sorted(items[i] | set(col["items"][i].as_py())))
                    clean.append(without(text[i], spans[-1]) if spans[-1] else col[text_col][i].as_py())
                new = {"hits": spans, "items": whole, "n_words": [len(s) for s in split], "clean_text": clean}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else col[f.name] for f in batch.schema], schema=batch.schema)

        out = out.mapInArrow(run, schema)
    return out


def batches_of(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not pa.types.is_string(b.schema.field(text_col).type) and not pa.types.is_large_string(b.schema.field(text_col).type):
            b = b.set_column(b.schema.get_field_index(text_col), text_col, b.column(text_col).cast(pa.string()))
        yield from blocks(iter([b]), text_col, SHARD_BYTES)


def without(text: str, spans: list[dict]) -> str:
    """The text less its spans of words and what lies between their words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["a"]][0]])
        last = at[s["b"] - 1][1]
    return "".join([*out, text[last:]])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
