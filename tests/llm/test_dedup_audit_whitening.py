"""Exact dedup, filter audit and whitening against brute force, on small fixtures with nulls, ties, empty and repeated rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lacuna.llm")
from lacuna.llm import exact_dedup, filter_audit, whitening  # noqa: E402
from lacuna.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LONG = "many words " * 100_000
TEXTS = [(5, "a b"), (3, "ab"), (9, "a\tb\n"), (2, None), (4, ""), (7, " \x0b "), (None, "a b"), (1, "Ünï cödé"), (6, "Ünïcödé"), (8, LONG), (10, LONG), (11, "\xa0"), (12, "x\0y"), (12, "x\0y"), (None, "lone"), (None, "lone")]


def groups(rows):
    """id, digest -> keep_id, size, by the contract."""
    held = defaultdict(list)
    for d, t in rows:
        held[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    out = {}
    for text, own in held.items():
        best = min(own)
        out[hashlib.sha256(text.encode()).hexdigest()] = (None if best[1] else best[2], len(own))
    return out


def compare(got, rows):
    want = groups(rows)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        digest = r.digest.hex()
        assert (r.keep_id, r.group_size) == want[digest]
        kept[digest] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert kept == Counter(want.keys())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 20_000])
def test_minimal_hash_is_a_bijection(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8)
    hashed = exact_dedup.MinimalHash.build(exact_dedup.words_of(digests))
    assert sorted(hashed.slots(exact_dedup.words_of(digests))) == list(range(n))
    assert len(hashed.bits) <= 8 * n + 200
    other = exact_dedup.words_of([hashlib.sha256(f"x{i}".encode()).digest() for i in range(100)])
    assert ((hashed.slots(other) >= -1) & (hashed.slots(other) < n)).all()


@pytest.mark.parametrize("history", [None, "true", "false", "id % 2 = 0"])
def test_groups_for_any_history(spark, history):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    compare(exact_dedup.groups_of(docs, history and F.expr(history)).collect(), TEXTS)


def test_groups_by_many_shards_and_few_hot(spark, monkeypatch):
    rows = [(i, f"text {i % 37 if i % 3 else 0} {'  ' * (i % 5)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for keys, hot in ((10, 2), (1 << 17, 1000), (500, 30)):
        monkeypatch.setattr(exact_dedup, "SHARD_KEYS", keys)
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        compare(exact_dedup.groups_of(docs).collect(), rows)


def test_lookup_tells_members_from_others(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "a "), (4, "c"), (5, "c"), (6, "d")], "doc_id long, text string")
    numbered = lambda df: exact_dedup.keyed(df).withColumn("row", F.col("id"))
    got = {r.keep_id: (r.group_size, r.member) for r in exact_dedup.lookup(exact_dedup.build(numbered(old), 4), numbered(new), 4).collect()}
    assert got == {3: (2, True), 2: (1, True), 4: (2, False), 6: (1, False)}


def test_deduplicate_keeps_one_row_a_text(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(TEXTS)], "doc_id long, text string, row int")
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got.collect()]
    assert len(kept) == len(set(kept)) == len(groups(TEXTS))
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_exact_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    want = groups(rows)
    got = exact_dedup.op11_exact_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = got.collect()
    assert sorted(r.doc_id for r in found) == sorted(d for d, _ in rows)
    assert all((r.keep_id, r.group_size, r.kept) == (*want[r.text_sha256], r.doc_id == r.keep_id) for r in found)
    assert exact_dedup.groups_of(table(spark, SMALL, "documents").limit(0)).count() == 0


def failures(rows):
    """part, failing filters of each row, in order."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        out.append((d, part or "", {f for f, x in own.items() if x}))
    return out


def audited(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1 and d is not None} for i in (0, 1))
    out, total = defaultdict(Counter), Counter()
    found = failures(rows)
    for order in map("".join, permutations("ABCDE")):
        for d, part, fails in found:
            for i, f in enumerate(order):
                c = out[part, order, i + 1]
                gone, own = bool(fails & set(order[:i])), f in fails
                c["kept"] += not gone and not own
                c["redundant"] += gone and own
                c["unique_fails"] += fails == {f}
                for name, held in (("removed", True), ("good_lost", d in good), ("toxic_lost", d in toxic)):
                    c[name] += own and not gone and held
        for part in {p for _, p, _ in found}:
            for i, f in enumerate(order):
                total[part, f] += out[part, order, i + 1]["removed"]
    names = filter_audit.COUNTS[:-1]
    return {k: (*[c[n] for n in names], total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def got_audit(df):
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in filter_audit.COUNTS) for r in df.collect()}


def test_audit_by_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(1, words, "en"), (2, words, "en"), (3, words, None), (None, words, "en"), (4, None, ""), (5, "", "de"), (6, "AB C#", "de"), (7, "AB C#", "en"), (8, "x " * 150, "en"), (9, words + " %", "en"), (9, words + " %", "en"), (10, words.upper(), "fr"), (2, "x y", "fr"), (11, LONG, "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"A": F.lit("clash"), "good": F.lit("clash")})
    got = got_audit(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_query(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, SMALL, "documents").collect()]
    labels = [tuple(r) for r in table(spark, SMALL, "labels").select("doc_id", "quality", "toxic").collect()]
    assert got_audit(filter_audit.op12_filter_audit(spark, SMALL)) == audited(rows, labels)


def test_shapley_shares_add_up(spark):
    rows = filter_audit.interactions(filter_audit.joint_failures(filter_audit.with_labels(filter_audit.with_copies(filter_audit.flagged(table(spark, SMALL, "documents"))), table(spark, SMALL, "labels"))))
    for order in ("ABCDE", "EDCBA"):
        for part, lost, shares in rows.where(F.col("filter_order") == order).groupBy("part").agg(F.sum("removed"), F.sum("shapley")).collect():
            assert shares == 120 * lost, part


def whitened(vectors):
    """x, n, S, eigenvalues, vectors of the contract, by a dense solver."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), fit.sum(axis=0), e[::-1], v[:, ::-1]


def check_whitening(rows, ids, vectors, components=16):
    x, n, sums, e, v = whitened(vectors)
    k = min(components, x.shape[1])
    assert len(rows) == k * len(ids)
    by = defaultdict(list)
    for r in rows:
        by[r.vec_id, r.component].append(r)
    white = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        sign = None
        for i, d in enumerate(ids):
            for r in by[d, j + 1][:1]:
                assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) or ids.count(d) > 1
                assert r.explained == pytest.approx(e[j] / e.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
                if ids.count(d) == 1 and abs(white[i, j]) > 1e-3:
                    sign = sign or np.sign(white[i, j]) * np.sign(r.whitened)
                    assert r.whitened == pytest.approx(sign * white[i, j], abs=1e-7)


def test_whitening_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fine = [rng.normal(size=6).tolist() for _ in range(60)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (None, fine[3]), (7, fine[8])]
    rows = list(enumerate(fine)) + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("clash"), "n": F.lit("clash")}).repartition(11)
    used = [(d, v) for d, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    for fan in (2, 32):
        monkeypatch.setattr(whitening, "FAN", fan)
        check_whitening(whitening.whiten(df).collect(), [d for d, _ in used], [v for _, v in used])


def test_whitening_query(spark):
    rows = [r for r in table(spark, SMALL, "embeddings").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    got = whitening.op13_whitening(spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    flat = whitening.whiten(make([(1, [2.0, 3.0]), (2, [4.0, 3.0]), (3, [2.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in flat) == [(1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0), (3, 1, 2, 128**2, 1.0, 1.0)]
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0])])).collect()


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.outer(np.arange(n), np.arange(n))):
        a = a + a.T
        d, v = whitening.symmetric_qr(a)
        assert np.allclose(d, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * max(1, np.abs(a).max())) and np.allclose(v.T @ v, np.eye(n)) and np.allclose(a @ v, v * d, atol=1e-9 * max(1, np.abs(a).max()))


def test_moments_merge_as_one_stream():
    x = np.random.default_rng(2).integers(0, 1000, (500, 3)) + 10**6
    whole, parts = whitening.Moments(3), [whitening.Moments(3) for _ in range(4)]
    whole.add(x)
    for p, rows in zip(parts, np.split(x, [1, 90, 400])):
        for one in rows:
            p.add(one[None, :])
    for p in parts[1:]:
        parts[0].merge(p)
    for m in (whole, parts[0]):
        assert m.n == 500 and (m.sums == x.sum(axis=0)).all() and np.allclose(m.square / 500, np.cov(x.T, bias=True), rtol=1e-12) and np.allclose(m.mean, x.mean(axis=0), rtol=1e-14)
