"""The operators against brute force, on small fixtures with nulls, empty and repeated rows."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lacuna.llm")
from lacuna.llm import chat_format, decontaminate, mixing, near_dedup, neighbours, pii, repeats, secret_scan, token_counts, toxicity  # noqa: E402
from lacuna.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PASSAGE = "the quick brown fox jumps over the lazy dog and runs off into the deep dark wood at night"
TEXTS = [(1, PASSAGE + " one"), (2, None), (3, ""), (4, PASSAGE + " one"), (5, "début " + PASSAGE + " ünd mehr"), (6, "a b"), (7, "A B"), (8, "x" * 300), (9, "x" * 120), (None, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("hits", F.lit("clash"))


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


def removed(rows, width=50):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows if d is not None]
    for d, raw in raws:
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_repeats(spark, docs, corpus):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats(docs).collect()}
    want = removed(TEXTS)
    assert {k: v for k, v in got.items() if k is not None} == want and got[None][1] == 0
    some = corpus[:80] + [(100000, corpus[3][1]), (100001, corpus[3][1][:70] + "zz" + corpus[5][1][20:120])]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == removed(some)


def test_repeats_by_small_parts(spark, corpus, monkeypatch):
    some = corpus[:120]
    frame = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    for name, value in (("HOT", 1), ("SHARD", 300), ("BATCH", 2000)):
        monkeypatch.setattr(repeats, name, value)
        assert {r.doc_id: tuple(r)[1:] for r in repeats.repeats(frame).collect()} == removed(some)


def test_repeats_of_odd_texts(spark):
    long = "".join(chr(97 + zlib.crc32(str(i).encode()) % 26) for i in range(200_000))
    rows = [(1, "ab" * 200), (2, "ab" * 90), (3, "x" + "ab" * 100 + "y"), (4, long), (5, long[100_000:100_300] + "é" * 60), (6, "é" * 60), (6, "é" * 70), (6, "é" * 60), (7, "z" * 49)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 400, 0), (2, 180, 180), (3, 202, 200), (4, 200_000, 0), (5, 420, 300), (6, 120, 120), (6, 120, 120), (6, 140, 140), (7, 49, 0)]
    assert repeats.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_sets(rows, width):
    """Word shingles as tuples, by a split of its own."""
    out = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def smallest_reachable(rows, sets, percent=80):
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            low[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(rows))]


def test_near_dedup_query(spark, corpus, tmp_path):
    from lacuna.llm.queries import QUERIES

    words = [f"w{i}" for i in range(90)]
    crowd = [(3000 + i, " ".join(f"e{i}x{k}" if k % 13 == i % 13 or k == i % 90 else w for k, w in enumerate(words))) for i in range(150)]
    near = [(5000 + i, t + " one more") for i, (_, t) in enumerate(corpus[:40])]
    twice = [(9000, corpus[50][1]), (9000, corpus[51][1] + " zz"), (9001, ""), (9002, None), (9003, "Ab\u00a0c D")]
    rows = corpus[:80] + crowd + near + twice
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_near_dedup"](spark, str(tmp_path)).collect())
    sets = shingle_sets(rows, 4)
    want = sorted((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, smallest_reachable(rows, sets)))
    assert got == want


def test_near_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, node string")
    assert near_dedup.near_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_dedup.near_components(rows).collect()) == [(0, 0), (0, 0), (3, 3)]


def test_near_dedup(spark, docs, corpus):
    rows = {r.doc_id: r for r in near_dedup.near_components(docs, 4).collect()}
    assert rows[4].component_id == 1 and rows[7].component_id == 6 and rows[2].n_shingles == 0 and rows[3].component_id == 3
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(words[:30] + [f"z{i}"] + words[31:])) for i in range(40)] + [(99, " ".join(words[::-1]))]
    some = corpus[:60] + [(1000 + i, t) for i, t in chain]
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(some, "doc_id long, text string"), 4).collect()}
    sets = {d: set(near_dedup.shingle_hashes(t, 4).tolist()) for d, t in some}
    low = {d: d for d in sets}
    for _ in range(len(sets)):
        old = dict(low)
        for a, b in itertools.combinations([d for d in sets if sets[d]], 2):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                low[a] = low[b] = min(low[a], low[b])
        if old == low:
            break
    assert got == low


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, "a b"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1].clean_text.strip() == "one" and got[5]["items"] == ["1"] and got[6]["items"] == ["2"] and got[7]["items"] == ["2"]
    assert got[8].hits == [] and got[2].n_words == 0 and len(got) == len(TEXTS)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert all(not r.hits for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_pii(spark):
    rows = [(1, "mail ann.b@mail.example.com or +1 (555) 123-4567, ip 10.2.3.4"), (2, "ann.b@mail.example.com"), (3, None), (4, ""), (5, "Mrs. Anna met Mr. Karl; 4111 1111 1111 1111"), (6, "clean text")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mail = re.search(r"\S+@\S+", got[1].text).group(0)
    assert mail == got[2].text != rows[1][1] and mail.endswith(".example.com") and re.fullmatch(r"[a-z]{3}\.[a-z]@[a-z]{4}\.example\.com", mail)
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip) == (1, 1, 1) and got[3].text is None and got[4].text == "" and got[6].text == "clean text"
    female, male, card = re.fullmatch(r"Mrs\. ([A-Z][a-z]+) met Mr\. ([A-Z][a-z]+); (\d{4} \d{4} \d{4} \d{4})", got[5].text).groups()
    digits = [int(c) for c in card.replace(" ", "")]
    assert female[-1] == "a" and male[-1] == "o" and sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0


def test_pii_mentions_of_one_entity(spark):
    rows = [(1, "Mr. Karl Braun; Mr Braun; Mr. Karl"), (2, "Ann.B@x.com ann.b@X.com"), (3, "+1 (555) 123-4567, 555-123-4567, +49 555 123 4567"), (4, "4111 1111 1111 1111 4111-1111-1111-1111"), (5, "Г-жа Ёлкина"), (6, "Mr Ωμεγα"), (7, "Frau Özil")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, __exc int, __tid int, __e int")
    out = pii.pseudonymise(df).collect()
    assert all((r["__exc"], r["__tid"], r["__e"]) == (1, 2, 3) for r in out)
    got = {r.doc_id: r.text for r in out}
    first, last, again, given = re.fullmatch(r"Mr\. (\w+) (\w+); Mr (\w+); Mr\. (\w+)", got[1]).groups()
    assert last == again and first == given and not {first, last} & {"Karl", "Braun"}
    a, b = got[2].split(" ")
    assert a != b and a.lower() == b.lower() != rows[1][1][:11].lower() and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z]@[a-z]\.com", a)
    numbers = [re.sub(r"\D", "", x)[-10:] for x in got[3].split(", ")]
    assert len(set(numbers)) == 1 and numbers[0] != "5551234567" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4}, \+49 \d{3} \d{3} \d{4}", got[3])
    assert re.fullmatch(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) \1-\2-\3-\4", got[4])
    assert re.fullmatch(r"Г-жа [А-Я][а-я]{4}а", got[5]) and re.fullmatch(r"Mr [Α-Ω][α-ω]{3}ο", got[6]) and re.fullmatch(r"Frau [A-Z][a-z]{2}a", got[7])


def test_pii_crowded_names(spark):
    rows = [(i, f"Mr. {a}{b}{c}") for i, (a, b, c) in enumerate(itertools.product("BCDFGHJKLM", "aeiou", "bcdfghj"))]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(got)) == len(rows) and all(re.fullmatch(r"Mr\. [A-Z][a-z]+o", t) for t in got)


def test_pii_stays_distinct(spark):
    rows = [(i, f"{a}@{b}.io") for i, (a, b) in enumerate(itertools.product("abcdefghij", repeat=2))]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.text for r in got}) == len(rows)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else "fr", f"src{i % 4}") for i in range(600)] + [(900, None, None, None), (901, "", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, mixing.tree(), 0.5, {("domain1",): 5.0}, seed=3).collect()
    spent = {}
    for r in out:
        key = (r.lang, r.source)
        spent.setdefault(key, [0, r.leaf_budget])[0] += r.n_tokens * r.copies
    assert spent and all(b - 5 <= t <= b + 1e-6 for t, b in spent.values())
    assert abs(sum(b for _, b in spent.values()) - 0.5 * sum(1 + i % 5 for i in range(600))) < 1e-6
    assert mixing.mix(df.limit(0), mixing.tree()).count() == 0


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ok = rows[:360]
    for q, v in ok:
        if q % 20 == 0:
            assert got.pop(q) == [i for _, i in sorted((-round(float(np.dot(v, x)), 9), i) for i, x in ok if i != q)[:5]]
    assert not got


def test_token_counts(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    some = corpus[:40] + TEXTS
    got = sorted(((r.doc_id or -1), r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(some, "doc_id long, text string"), path).collect())
    assert got == sorted((d or -1, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in some)


def test_secrets(spark):
    text = "é token = 'abcdefghijkl' AKIA" + "B" * 14 + " " + "0123456789abcdef"
    rows = [(1, text), (2, None), (3, ""), (4, "password: short")]
    got = {r.doc_id: [(s.kind, s.start_at, s.end_at) for s in r.spans] for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, *_ in got[1]] == ["assign", "access", "hex"] and got[2] == got[3] == got[4] == []


def brute(names):
    best = None
    for target in itertools.product(chat_format.NAMES, repeat=len(names)):
        s, cost = chat_format.START, 0
        for n, t in zip(names, target):
            r = chat_format.role_of(n)
            cost += chat_format.step(s, t)[0] + (0 if r == t else chat_format.RELABEL_UNKNOWN if r is None else chat_format.RELABEL)
            s = t
        cost += chat_format.CLOSE[s][0]
        best = cost if best is None else min(best, cost)
    return best


def test_chat_format(spark, monkeypatch):
    roles = ["system", "user", "assistant", None]
    convs = list(itertools.product(roles, repeat=4))
    rows = [(i, k, r, f"t{k}") for i, c in enumerate(convs) for k, r in enumerate(c)] + [(0, 0, "system", "t0"), (None, None, None, None)]
    for size in (256, 2):
        monkeypatch.setattr(chat_format, "SEGMENT", size)
        got = chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        whole = {}
        for r in sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.segment)):
            whole[r.conv_id] = (r.cost, whole.get(r.conv_id, (0, ""))[1] + r.rendered)
        for i, c in enumerate(convs):
            assert whole[i][0] == brute(c), c
            assert re.fullmatch(r"(S)?(UA)*", "".join({"system": "S", "user": "U", "assistant": "A"}[x] for x in re.findall(r"<\|(\w+)\|>", whole[i][1]))), whole[i]
            assert re.findall(r"t\d", whole[i][1]) == ["t0", "t1", "t2", "t3"]


def test_toxicity(spark):
    rows = [(i, f"plain words number {chr(97 + i % 26) * 3} here" + (" you idiot scum" if i % 5 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2) and got[1000] < 0.3 and got[1001] < 0.3
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    n = out.count()
    assert 0 < n <= table(spark, SMALL, "documents").count() and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


def test_stages_keep_columns_with_clashing_names(spark):
    import corpus_pipeline

    rows = [(1, PASSAGE, "en", "src1", 7.0, 1, "p"), (2, None, None, None, 8.0, 2, "q"), (3, "", "fr", "src2", 9.0, 3, "r"), (None, "plain words here", "en", "src1", 1.0, 4, "s"), (1, PASSAGE, "en", "src1", 7.0, 1, "p")]
    names = ["doc_id", "text", "lang", "source", "score", "part", "node"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, part int, node string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SMALL)
        assert out.columns[: len(names)] == names and (name == "mixing" or sorted(r.part for r in out.collect())[:4] in ([1, 1, 2, 3], [1, 2, 3, 4])), name
        assert {(r.score, r.part, r.node) for r in out.collect()} <= {(r[4], r[5], r[6]) for r in rows}
        assert stage(spark, df.limit(0), SMALL).count() == 0, name


def test_mixing_with_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 3), "en", f"src{i % 2}", 1, 2.0, 3, 4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part int, budget double, whole int, buckets int")
    out = mixing.mix(df, mixing.tree(), 0.5).collect()
    assert out and all((r.part, r.budget, r.whole, r.buckets) == (1, 2.0, 3, 4) for r in out)


def test_items_without_an_id(spark, docs):
    bench = spark.createDataFrame([(None, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[1].hits and got[1]["items"] == []
