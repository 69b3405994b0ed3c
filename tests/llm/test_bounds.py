"""op7 on components of any size, op10's windows against plain loops, both queries by their contracts."""

import hashlib
import heapq
import re

import numpy as np
import pytest

from lacuna.llm import decontaminate, neighbours
from lacuna.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(rows, k=20):
    found = []
    for q, v in rows:
        if q % 20 == 0:
            products = [(float(np.einsum("i,i->", v, w)), c) for c, w in rows if c != q and len(w) == len(v)]
            scores = [(np.inf if np.isnan(s) else -s, c) for s, c in products]
            found += [(q, r, c, -s) for r, (s, c) in enumerate(heapq.nsmallest(k, scores), 1)]
    return found


@pytest.mark.parametrize("scale", [1e-310, 1e-160, 1.0, 1e100, 1e153, 1e200])
def test_components_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-50, 50, 6) * scale * (1e-9 if i % 3 == 0 else 1.0)).tolist()) for i in range(60)]
    rows = [(i, v) for i, v in rows if any(v)]
    with np.errstate(over="ignore", invalid="ignore"):
        want = brute([(i, np.array(v)) for i, v in rows])
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    if scale == 1.0:
        assert [g[:3] for g in got] == [w[:3] for w in want]
    assert len(got) == len(want) == 60 and all(g[3] == w[3] or abs(g[3] - w[3]) <= 1e-12 * abs(w[3]) + 1e-300 for g, w in zip(got, want))


def windows(text, width=10):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)]


def test_windows_in_arrays():
    items = [("b", "one two three"), ("a", "one two three"), (None, "four"), ("c", None), ("d", ""), ("e", " ".join(f"w{i % 11}" for i in range(40))), ("é", "one")]
    held = decontaminate.Windows(items)
    want = {}
    for item, text in items:
        for w in windows(text)[1]:
            want.setdefault(w, set()).update([] if item is None else [item])
    back = {n: w for w, n in held.vocab.items()}
    got = {tuple(back[x] for x in row if x): set(held.items(i)) for i, row in enumerate(held.pattern.tolist())}
    assert got == want and held.least == 1 and [len([x for x in row if x]) for row in held.pattern.tolist()] == held.length.tolist()
    assert len(decontaminate.Windows([]).pattern) == len(decontaminate.Windows([("x", None)]).pattern) == 0


def test_op10_query(spark):
    tests = {}
    for r in table(spark, SMALL, "benchmark").collect():
        for w in windows(r.text)[1]:
            tests.setdefault(w, set()).add(str(r.item_id))
    lengths, want = sorted({len(w) for w in tests}), {}
    for r in table(spark, SMALL, "documents").collect():
        text, hit, items = windows(r.text)[0], set(), set()
        for n in lengths:
            for i in range(len(text) - n + 1):
                if tuple(text[i : i + n]) in tests:
                    hit |= set(range(i, i + n))
                    items |= tests[tuple(text[i : i + n])]
        want[r.doc_id] = (len(text), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op10_decontaminate(spark, SMALL).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_op7_query(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, SMALL, "embeddings").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    got = [tuple(r)[:3] for r in neighbours.op7_neighbours(spark, SMALL).orderBy("query_id", "rank").collect()]
    assert got == [w[:3] for w in brute(rows)]
