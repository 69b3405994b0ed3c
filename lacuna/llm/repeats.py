"""Repeated passages: bytes of a 50-byte string that also starts in a document with a smaller id.

Burrows-Wheeler transforms of shards are merged by refining their interleave,
without sorting the suffixes of all shards again:

1. Texts are cut where their content says so, into chunks of about ``CHUNK``
   bytes, each with what its last strings reach into. In all but the smallest
   document that holds a chunk, its strings start in a smaller one; they need no
   further look, neither as repeats nor as what others repeat.
2. Winnowing gives each other string of ``width`` bytes an anchor, the smallest hash
   of the ``GRAM``-byte strings in it, by content alone. Anchors that occur in
   one document only lie in no repeat. Neighbouring strings of one anchor
   form a segment; only segments of shared anchors go on, equal ones once.
3. Segments are dealt by anchor, so equal strings meet. A task cuts what it
   gets, by whole anchors, into shards of ``SHARD`` bytes, and builds the
   transform of each. All shards of a batch are then merged: the interleave
   that is right for k - 1 characters is made right for k by one stable
   distribution by the character before. Where a new block begins in round k,
   the common prefix with the suffix above is k - 1 long; after ``width``
   rounds the blocks are the intervals of repeated strings. Blocks of one
   document are dropped on the way.
4. The smallest document of an interval owns its strings; in later
   documents, the bytes of these strings go.

An anchor with more than ``HOT`` distinct segments would not fit into a task;
its strings are refined to full depth at once, by an aggregation over them.

Cases: null texts are empty; texts under ``width`` bytes keep all bytes; rows
that repeat an id are one document for each text; null ids neither lose bytes nor
take any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, buffer_of, discard, materialize, ranges, reclaim, table

WIDTH, GRAM, CHUNK = 50, 16, 128
#: Bytes of a shard and of the shards merged at once; strings of a segment; distinct segments of an anchor that a task takes.
SHARD, BATCH, LONGEST, HOT = 1 << 18, 2 << 20, 256, 1 << 16
#: Characters from one look for blocks of one owner to the next.
PRUNE = 6
#: Ranges of places of an anchor in a string that are looked at together.
BANDS = 4
#: Bytes that are hashed at once: short texts together, a longer one whole.
PIECE = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(raw: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each ``width``-byte string, by doubling of polynomial hashes."""
    now, size = _BYTES[raw], 1
    total, at = None, 0
    power = base
    left = width
    while left:
        if left & 1:
            part = now[at : at + len(raw) - width + 1]
            total = part.copy() if total is None else total * power + part
            at += size
        left >>= 1
        if left:
            now = now[: len(now) - size] * power + now[size:]
            power = np.uint64((int(power) ** 2 * 3 + 2) % (1 << 64))
            size *= 2
    return _mix(total)


def lowest(raw: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each string of ``width`` bytes."""
    if len(raw) < width:
        return np.zeros(0, np.int64)
    gram = min(GRAM, width)
    low = gram_hashes(raw, gram, _BASE)
    count, w, size = len(raw) - width + 1, width - gram + 1, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:count], low[w - size : w - size + count]).view(np.int64)


def pieces(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of about ``size`` bytes of the texts that ``off`` bounds, whole texts."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield int(off[i]), int(off[j])
        i = j


def strings_in(off: np.ndarray, width: int) -> np.ndarray:
    """Where strings of ``width`` bytes begin that end in the same text; any other text begins behind a place without one."""
    out = np.ones(off[-1], bool)
    for a, b in zip(np.maximum(off[:-1], off[1:] - width + 1).tolist(), off[1:].tolist()):
        out[a:b] = False
    return out


def bounds(lists: pa.Array, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run (at, n) that the texts' lists hold; a null list is empty."""
    held = lists.flatten()
    at = held.field("at").to_numpy() + np.repeat(off[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return zip(at.tolist(), (at + held.field("n").to_numpy()).tolist())


def _chunks(width: int):
    """(doc_id, h, at, n, cid, other): the n strings from ``at`` on, and the hash of all their bytes; other is null but where the block itself holds them in a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raw, off = buffer_of(batch.column("text"))
            edge = np.zeros(len(raw), bool)
            for a, b in pieces(off, PIECE):
                cuts = gram_hashes(raw[a:b], min(GRAM, width), _BASE) % np.uint64(CHUNK) == 0
                edge[a : a + len(cuts)] = cuts
            edge[off[:-1][off[:-1] < len(raw)]] = True
            at = np.flatnonzero(edge & strings_in(off, width))
            row = np.searchsorted(off, at, side="right") - 1
            n = np.minimum(np.append(at[1:], len(raw)), off[row + 1] - width + 1) - at
            whole = raw.tobytes()
            cid = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(at.tolist(), (at + n + width - 1).tolist())]
            doc, h = batch.column("doc_id").to_numpy()[row], batch.column("h").to_numpy()[row]
            least: dict[bytes, int] = {}
            for name, d in zip(cid, doc.tolist()):
                if d < least.setdefault(name, d):
                    least[name] = d
            first = doc == np.array([least[name] for name in cid], np.int64)
            cells = [pa.array(doc), pa.array(h), pa.array(at - off[row], pa.int32()), pa.array(n, pa.int32()), pa.array(cid, pa.binary()), pa.array(doc, mask=first)]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "h", "at", "n", "cid", "other"])

    return run


def anchored(raw: np.ndarray, off: np.ndarray, gone: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, anchor) of neighbouring strings of one anchor, but those in the runs ``gone``; places are those in ``raw``."""
    use = strings_in(off, width)
    for a, b in bounds(gone, off):
        use[a:b] = False
    head = np.zeros(len(raw) + 1, bool)
    head[off[:-1]] = True
    found: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for a, b in pieces(off, PIECE):
        low = lowest(raw[a:b], width)
        if not len(low):
            continue
        here = use[a : a + len(low)]
        first = np.concatenate([[True], (low[1:] != low[:-1]) | (here[1:] != here[:-1]) | head[a + 1 : a + len(low)]])
        at = np.flatnonzero(first)
        stop = np.append(at[1:], len(low))
        taken = here[at]
        at = at[taken]
        for x, y in zip(found, (at + a, stop[taken] + a, low[at])):
            x.append(y)
    start, stop, anchor = (np.concatenate(x) for x in found)
    return np.searchsorted(off, start, side="right") - 1, start, stop, anchor


def _anchor_rows(width: int):
    """(anchor, doc_id, done): done where the block itself shows that the anchor is shared, which others learn from one row without a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raw, off = buffer_of(batch.column("text"))
            row, _, _, anchor = anchored(raw, off, batch.column("gone"), width)
            if not len(row):
                continue
            doc = batch.column("doc_id").to_numpy()[row]
            order = np.argsort(anchor)
            anchor, doc = anchor[order], doc[order]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            at = np.flatnonzero(first)
            low = np.minimum.reduceat(doc, at)
            several = low < np.maximum.reduceat(doc, at)
            lone, marks = at[~several], anchor[at[several]]
            done = several[np.cumsum(first) - 1]
            both = np.stack([anchor[done], doc[done]])
            both = both[:, np.lexsort(both[::-1])]
            both = both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)])[: both.shape[1]]]
            known, count = len(lone) + both.shape[1], len(lone) + both.shape[1] + len(marks)
            place = np.arange(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([anchor[lone], both[0], marks])), pa.array(np.concatenate([low[~several], both[1], np.zeros(len(marks), np.int64)]), mask=place >= known), pa.array((place >= len(lone)) & (place < known))],
                names=["anchor", "doc_id", "done"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor) of shared anchors, from rows sorted by anchor; of the last run only its state is kept."""
    last, lone, known = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, done = batch.column("anchor").to_numpy(), batch.column("done").to_numpy(zero_copy_only=False)
        mark = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy()
        out = [(doc[done], anchor[done])]
        anchor, doc, mark = anchor[~done], doc[~done], mark[~done]
        if len(anchor):
            if last == int(anchor[0]) and (lone is not None or known):
                # what the last batch left of this run: a document of its own, or that it is shared
                anchor, doc, mark = np.insert(anchor, 0, last), np.insert(doc, 0, lone or 0), np.insert(mark, 0, known)
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            at, which = np.flatnonzero(first), np.cumsum(first) - 1
            some = ~mark
            lo = np.minimum.reduceat(np.where(some, doc, np.iinfo(np.int64).max), at)
            hi = np.maximum.reduceat(np.where(some, doc, np.iinfo(np.int64).min), at)
            shared = np.logical_or.reduceat(mark, at) | (lo < hi)
            hit = shared[which] & some
            out.append((doc[hit], anchor[hit]))
            last, known = int(anchor[-1]), bool(shared[-1])
            lone = None if known else int(lo[-1])
        both = [np.concatenate(x) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["doc_id", "anchor"])


def _segments(width: int):
    """Segments of shared anchors; a block holds the bytes of equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raw, off = buffer_of(batch.column("text"))
            row, start, stop, anchor = anchored(raw, off, batch.column("gone"), width)
            # an anchor is shared or not, whatever the document
            shared = np.unique(batch.column("shared").flatten().to_numpy())
            use = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)] == anchor)
            parts = -(-(stop[use] - start[use]) // LONGEST)
            which = np.repeat(use, parts)
            begin = start[which] + LONGEST * ranges(np.zeros(len(use), np.int64), parts)
            end = np.minimum(begin + LONGEST, stop[which]) + width - 1
            whole = raw.tobytes()
            segs = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            names = [xxhash.xxh3_128_digest(seg) for seg in segs]
            seen: set[bytes] = set()
            once = [None if name in seen or seen.add(name) else seg for name, seg in zip(names, segs)]
            doc, h, row = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy(), row[which]
            cells = [doc[row], h[row], begin - off[row], anchor[which], names, once]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "h", "start", "anchor", "sid", "seg"])

    return run


def promising(raw: np.ndarray, off: np.ndarray, anchor: np.ndarray, owner: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Segments that may hold a repeat: several documents have what all strings with the anchor about one place have in common.

    The places of the anchor in a string fall into ``BANDS``. Where an anchor
    occurs twice in a segment, all its segments go on.
    """
    gram = min(GRAM, width)
    string = np.repeat(np.arange(len(anchor)), np.diff(off))
    found = gram_hashes(raw, gram, _BASE).view(np.int64)
    place = np.flatnonzero(found == anchor[string[: len(found)]])
    place = place[place + gram <= off[string[place] + 1]]
    which = string[place]
    alone = np.bincount(which, minlength=len(anchor)) == 1
    at = np.zeros(len(anchor), np.int64)
    at[which] = place
    out = np.isin(anchor, anchor[~alone])
    single = ~out
    edges = np.linspace(0, width - gram + 1, BANDS + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:]):
        first, size = at - low, width - (high - 1 - low)
        who = np.flatnonzero((first >= off[:-1]) & (first + size <= off[1:]) & single)
        if low == high or not len(who):
            continue
        key = np.zeros(len(who), np.uint64)
        for k in range(size):
            key = key * _BASE + _BYTES[raw[first[who] + k]]
        order = np.argsort(key)
        who, key = who[order], key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(owner[who], heads) < np.maximum.reduceat(last[who], heads)
        out[who[np.repeat(several, np.diff(np.append(heads, len(who))))]] = True
    return out


class Shard:
    """Strings laid end to end, the places of their suffixes in order, and the transform; each string ends in a character of its own."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray, end: int):
        n = len(raw) + len(lengths)
        stops = np.cumsum(lengths + 1) - 1
        text = np.full(n, end, np.uint8 if end < 256 else np.uint16)
        inside = np.ones(n, bool)
        inside[stops] = False
        text[inside] = raw
        # some characters at once, none after an end, and the place; suffixes that end so soon go by their string
        bits = n.bit_length()
        if 3 * bits > 63:
            raise ValueError("a shard holds at most 2^21 characters")
        left = np.repeat(stops, lengths + 1) - np.arange(n)
        size = (63 - bits) // int(end).bit_length()
        key = np.zeros(n, np.int64)
        for k in range(min(size, n)):
            key <<= int(end).bit_length()
            key[: n - k] += np.where(left[: n - k] >= k, text[k:], 0)
        order, fresh = self._sorted(key, np.arange(n), bits)
        fresh[1:] |= left[order[1:]] < size
        # then by ranks of twice as many, those only that are not alone in theirs
        rank, place = np.empty(n, np.int64), np.arange(n)
        now = order
        while True:
            heads = np.flatnonzero(fresh)
            several = np.repeat(np.diff(np.append(heads, len(now))) > 1, np.diff(np.append(heads, len(now))))
            rank[now] = place[heads][np.cumsum(fresh) - 1]
            now, place = now[several], place[several]
            if not len(now):
                break
            now, fresh = self._sorted(rank[now] << bits | rank[now + size], now, bits)
            order[place] = now
            size *= 2
        self.order, self.bwt = order, text[order - 1]

    @staticmethod
    def _sorted(key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The places by (key, place), and where the key is another than before."""
        both = np.sort(key << bits | place)
        return both & (1 << bits) - 1, np.diff(both >> bits, prepend=-1) != 0


def merge(shards: list[np.ndarray], owner: list[np.ndarray], depth: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of the suffixes that agree with one of another owner in ``depth`` characters, in merged order.

    Takes the transforms and each row's owner; rows count through all shards.
    A round distributes the interleave of the last one by the two characters before, or by one.
    Blocks of one owner are left out: what lies before them is such a block too.
    """
    bwt, held = np.concatenate(shards), np.concatenate(owner)
    before = np.empty(len(bwt), np.int32)
    start = 0
    for part in shards:
        before[start + np.argsort(part, kind="stable")] = np.arange(start, start + len(part), dtype=np.int32)
        start += len(part)
    row, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    # two characters at once, where both fit into 16 bits; none is above the end
    steps = [(1, bwt, before)]
    if bwt.dtype == np.uint8:
        steps.append((2, np.where(bwt == end, np.uint16(0xFFFF), bwt[before].astype(np.uint16) << 8 | bwt), before[before]))
    k = 0
    while k < depth:
        size, chars, back = steps[-1 if depth - k > 1 else 0]
        k += size
        char = chars[row]
        order = np.argsort(char, kind="stable")[: len(row) - int((char >= end << 8 * (size - 1)).sum())]
        if not len(order):
            return row[:0], block[:0]
        char, old, row = char[order], block[order], back[row[order]]
        fresh = np.concatenate([[True], (char[1:] != char[:-1]) | (old[1:] != old[:-1])])
        block = np.cumsum(fresh, dtype=np.int32) - 1
        if k % PRUNE == 0 or k == depth:
            at, who = np.flatnonzero(fresh), held[row]
            kept = (np.minimum.reduceat(who, at) < np.maximum.reduceat(who, at))[block]
            row, block = row[kept], block[kept]
    return row, block


def owners(raw: np.ndarray, off: np.ndarray, owner: np.ndarray, width: int, shard: int) -> np.ndarray:
    """For each start of a string of ``width`` bytes in the segments, the smallest owner of an equal string; elsewhere the largest number."""
    lengths = np.diff(off)
    end = 256 if len(raw) and raw.max() == 255 else 255
    cuts = np.unique(np.searchsorted(off, np.arange(0, off[-1], shard)))
    cuts = np.append(cuts[cuts < len(lengths)], len(lengths))
    shards = [Shard(raw[off[a] : off[b]], lengths[a:b], end) for a, b in zip(cuts[:-1], cuts[1:])]
    string = np.repeat(np.arange(len(lengths)), lengths + 1)
    begins = np.cumsum([0, *[len(s.bwt) for s in shards]])
    place = np.concatenate([s.order + b for s, b in zip(shards, begins)])
    held = owner[string[place]]
    row, block = merge([s.bwt for s in shards], np.split(held, begins[1:-1]), width, end)
    out = owner[string]
    if len(row):
        at = np.flatnonzero(np.diff(block, prepend=-1))
        out[place[row]] = np.repeat(np.minimum.reduceat(held[row], at), np.diff(np.append(at, len(row))))
    left = np.repeat(np.cumsum(lengths + 1), lengths + 1) - np.arange(len(string)) - 1
    out[left < width] = np.iinfo(np.int64).max
    return out


def _merged(width: int, shard: int, batch_bytes: int):
    """Runs of strings with one owner, for segments sorted by anchor: (sid, skip, count, owner)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        raw, off = buffer_of(rows.column("seg").combine_chunks())
        rows = rows.filter(pa.array(promising(raw, off, *(rows.column(c).to_numpy() for c in ("anchor", "owner", "last")), width))).combine_chunks()
        raw, off = buffer_of(rows.column("seg").combine_chunks())
        found = owners(raw, off, rows.column("owner").to_numpy(), width, shard)
        lengths = np.diff(off) + 1
        begins = np.cumsum(lengths) - lengths
        string = np.repeat(np.arange(len(lengths)), lengths)
        fresh = np.concatenate([[True], (found[1:] != found[:-1]) | (string[1:] != string[:-1])])
        at = np.flatnonzero(fresh)
        count = np.diff(np.append(at, len(found)))
        used = found[at] < rows.column("last").to_numpy()[string[at]]
        at, count = at[used], count[used]
        return pa.RecordBatch.from_arrays([rows.column("sid").combine_chunks().take(pa.array(string[at])), pa.array(at - begins[string[at]], pa.int32()), pa.array(count, pa.int32()), pa.array(found[at])], names=["sid", "skip", "count", "owner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("seg").nbytes
            if size >= batch_bytes:
                rows = pa.Table.from_batches(held)
                anchor = rows.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield solve(rows.slice(0, cut))
                rest = rows.slice(cut).combine_chunks()
                held = rest.to_batches()
                size = sum(b.column("seg").slice(0).nbytes for b in held) if len(rest) < len(rows) else size
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _digest(width: int):
    kinds = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            raw, off = buffer_of(batch.column("text"))
            out = np.zeros(len(raw) + 1, bool)
            for a, b in bounds(batch.column("gone"), off):
                out[a : b + width - 1] = True
            begins = out[:-1].copy()
            begins[1:] &= ~out[:-2]
            heads = off[:-1][off[:-1] < len(raw)]
            begins[heads] = out[heads]
            counts = [np.diff(np.concatenate([[0], np.cumsum(x)])[off]) for x in (out[:-1], begins)]
            digests = []
            for a, b, n in zip(off[:-1].tolist(), off[1:].tolist(), counts[0].tolist()):
                part = raw[a:b]
                digests.append(hashlib.sha256(part[~out[a:b]] if n else part).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip((np.diff(off), *counts, digests), kinds)]], names=["doc_id", *kinds.names])

    return run


def _deep(kinds: DataFrame, width: int) -> DataFrame:
    """The runs of segments, by an aggregation over all their strings."""
    cut = F.transform(F.sequence(F.lit(1), F.length("seg") - width + 1), lambda i: F.substring("seg", i, F.lit(width)))
    each = kinds.select("sid", "owner", "last", F.posexplode(cut).alias("skip", "string"))
    each = each.select("sid", "owner", "last", "skip", F.xxhash64("string").alias("x"), F.xxhash64(F.lit(1), "string").alias("y"))
    least = each.groupBy("x", "y").agg(F.min("owner").alias("least"))
    return each.join(least, ["x", "y"]).where("least < last").select("sid", "skip", F.lit(1).alias("count"), F.col("least").alias("owner"))


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    run = F.struct("at", "n")
    chunks = known.mapInArrow(_chunks(width), "doc_id long, h long, at int, n int, cid binary, other long")
    # of a common chunk, a block sends one document to the others
    owner = F.min("doc_id").over(Window.partitionBy("cid", "other"))
    copied = materialize(chunks.withColumn("owner", owner).where("other IS NOT NULL OR owner < doc_id").select("doc_id", "h", "at", "n"), "copied")
    reclaim(docs.sparkSession)
    listed = copied.groupBy("doc_id", "h").agg(F.collect_list(run).alias("gone"))

    made = known.join(listed, ["doc_id", "h"], "left").select("doc_id", "text", "gone").mapInArrow(_anchor_rows(width), "anchor long, doc_id long, done boolean")
    dealt = made.repartition(F.when(F.col("done"), F.col("doc_id")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor")
    shared = materialize(dealt.mapInArrow(_shared, "doc_id long, anchor long"), "anchors")
    reclaim(docs.sparkSession)
    lists = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    # by the id alone, as the anchors are, so that texts are dealt once
    runs = copied.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "n")).alias("gone"))
    gone = F.filter("gone", lambda g: g["h"] == F.col("h")).alias("gone")
    left = known.join(lists, "doc_id").join(runs, "doc_id", "left").select("doc_id", "h", "text", "shared", gone)
    cut = materialize(left.mapInArrow(_segments(width), "doc_id long, h long, start int, anchor long, sid binary, seg binary"), "segments")
    discard(shared)
    reclaim(docs.sparkSession)

    kinds = cut.groupBy("sid").agg(F.max("anchor").alias("anchor"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max("seg").alias("seg"))
    kinds = materialize(kinds, "kinds")
    reclaim(docs.sparkSession)
    # written first: its size then decides how the joins with it run
    hot = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    crowded = not hot.isEmpty()
    few = (kinds.join(hot, "anchor", "left_anti") if crowded else kinds).select("anchor", "sid", "owner", "last", "seg")
    found = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merged(width, SHARD, BATCH), "sid binary, skip int, count int, owner long")
    owned = materialize(found.union(_deep(kinds.join(hot, "anchor", "left_semi"), width)) if crowded else found, "owned")
    discard(hot)
    reclaim(docs.sparkSession)
    taken = cut.select("doc_id", "h", "start", "sid").join(owned, "sid").where("owner < doc_id").select("doc_id", "h", (F.col("start") + F.col("skip")).alias("at"), F.col("count").alias("n"))
    gone = materialize(taken.union(copied).groupBy("doc_id", "h").agg(F.collect_list(run).alias("gone")), "gone")
    discard(cut, kinds, owned, copied)
    out = rows.join(gone, ["doc_id", "h"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_digest(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
