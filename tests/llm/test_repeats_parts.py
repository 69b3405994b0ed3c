"""The parts of op2 that run in tasks, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lacuna.llm")
from lacuna.llm import repeats  # noqa: E402

GONE = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def batch(texts, gone=None, shared=None):
    n = len(texts)
    cells = {"doc_id": pa.array(range(n), pa.int64()), "h": pa.array(range(n), pa.int64()), "text": pa.array(texts), "gone": pa.array(gone or [None] * n, GONE), "shared": pa.array(shared or [[0]] * n, pa.list_(pa.int64()))}
    return pa.RecordBatch.from_pydict(cells)


def test_short_texts_are_hashed_together(monkeypatch):
    """A call for each short text took longer than its hashes."""
    calls, hashes = [], repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda *a: calls.append(1) or hashes(*a))
    rows = batch([f"{i:060d}" for i in range(2000)])
    for part in (repeats._chunks(50), repeats._anchor_rows(50), repeats._segments(50)):
        calls.clear()
        assert sum(b.num_rows for b in part(iter([rows]))) >= 0
        assert len(calls) <= 10


@pytest.mark.parametrize("piece", [1, 100, 1 << 15])
@pytest.mark.parametrize("width", [1, 5, 50])
def test_strings_and_anchors(monkeypatch, piece, width):
    """Every string that is not gone is in one run, with the anchor that it has by itself."""
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(3)
    texts = ["", None, "x" * 300] + ["".join(rng.choice(list("abé"), k)) for k in rng.integers(0, 130, 60)] + [""]
    gone = [None if i % 3 else [{"at": k, "n": 3} for k in range(0, len((t or "").encode()) - width - 2, 7)] for i, t in enumerate(texts)]
    rows = batch(["s" * 9, *texts], [None, *gone]).slice(1)
    raws = [(t or "").encode() for t in texts]
    raw, off = repeats.buffer_of(rows.column("text"))
    got = {}
    for row, start, stop, anchor in zip(*(x.tolist() for x in repeats.anchored(raw, off, rows.column("gone"), width))):
        for p in range(start, stop):
            assert got.setdefault((row, p - int(off[row])), anchor) == anchor
    shut = {(i, p) for i, runs in enumerate(gone) for g in runs or [] for p in range(g["at"], g["at"] + g["n"])}
    assert got == {(i, p): int(low) for i, r in enumerate(raws) for p, low in enumerate(repeats.lowest(np.frombuffer(r, np.uint8), width)) if (i, p) not in shut}


@pytest.mark.parametrize("alphabet", [b"ab", bytes([0, 1]), bytes([253, 254]), bytes([254, 255])])
@pytest.mark.parametrize("width", [4, 7, 12])
def test_owners(width, alphabet):
    """The smallest owner of each string, at even and odd depths, with shards of one string and of many."""
    rng = np.random.default_rng(width)
    for shard in (1, 60, 1 << 18):
        strings = [bytes(rng.choice(list(alphabet), k).tolist()) for k in rng.integers(width, 3 * width, 30)]
        owner = rng.integers(0, 9, len(strings))
        least = {}
        for s, who in zip(strings, owner.tolist()):
            for p in range(len(s) - width + 1):
                least[s[p : p + width]] = min(who, least.get(s[p : p + width], who))
        off = np.cumsum([0, *map(len, strings)])
        got = repeats.owners(np.frombuffer(b"".join(strings), np.uint8), off, owner, width, shard)
        none = np.iinfo(np.int64).max
        assert got.tolist() == [least[s[p : p + width]] if p <= len(s) - width else none for s in strings for p in range(len(s) + 1)]


def test_segments_that_may_hold_a_repeat():
    """A segment goes on if and only if a string about its anchor may be in another document; 34 common bytes at one side were enough before."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 66).astype(np.uint8)
    low = repeats.lowest(text, 50)
    gram = int(np.flatnonzero(repeats.gram_hashes(text, 16, repeats._BASE).view(np.int64) == low[0])[0])
    assert (low == low[0]).sum() > 1
    strings = [text, text.copy(), text.copy()]
    strings[1][: max(gram - 1, 0)] += 1
    strings[1][gram + 16 + 20 :] += 1
    off = np.cumsum([0, *map(len, strings)])
    for some, want in (([0, 2], [True, True]), ([0, 1], [False, False]), ([0, 1, 2], [True, False, True])):
        raw = np.concatenate([strings[i] for i in some])
        owner = np.arange(len(some), dtype=np.int64)
        got = repeats.promising(raw, off[: len(some) + 1], np.full(len(some), low[0]), owner, owner, 50)
        assert got.tolist() == want, (some, gram)


def test_a_block_sends_one_document_of_a_common_chunk():
    """The others learn from the block that a smaller document has it, so that its rows do not meet in one task."""
    (out,) = repeats._chunks(50)(iter([batch(["p" * 70 + "q" * 5] * 40)]))
    rows = out.to_pylist()
    assert {r["doc_id"] for r in rows if r["other"] is None} == {0}
    assert all(r["other"] == r["doc_id"] for r in rows if r["doc_id"]) and {r["doc_id"] for r in rows} == set(range(40))
