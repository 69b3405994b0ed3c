"""Texts of a megabyte made to strain each PII expression, and repeated rows in the mix."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lacuna.llm")
from lacuna.llm import mixing, pii  # noqa: E402

M = 1 << 20
STRAINS = {
    "labels": "x@" + "a." * (M // 2) + "com", "at": "a@" * (M // 2), "local": "a" * M, "domain": "x@" + "a" * M, "last": "x@y." + "a" * M, "dots": "x@" + "." * M + "com", "dashes": "x@a" + "-." * (M // 2) + "com",
    "octets": "1." * (M // 2), "digits": "1" * M, "groups": "4111 " * (M // 5), "phones": "555-" * (M // 4), "plus": "+1 " * (M // 3), "name": "Mr. A" + "a" * M, "names": "Mr. " * (M // 4), "capitals": "Mr. " + "Aa-" * (M // 3), "short": "x@" + "a." * 4000 + "com",
}


def test_pii_expressions_on_long_texts(spark):
    """They neither overflow the stack nor take more than linear time."""
    docs = spark.createDataFrame(list(STRAINS.items()), "doc_id string, text string").repartition(4)
    got = {r.doc_id: (r.m, r.g) for r in docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({pii.ANY})"), F.lit(1))).alias("m"), F.size(F.split("text", pii.ANY, -1)).alias("g")).collect()}
    assert got.keys() == STRAINS.keys() and all(g == m + 1 for m, g in got.values())
    assert got["labels"][0] == got["short"][0] == got["local"][0] == got["digits"][0] == 0 and got["groups"][0] == M // 20


def test_pii_of_strained_texts(spark):
    docs = spark.createDataFrame([(n, t[:8005] + " ann@example.org") for n, t in STRAINS.items()], "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs).collect()}
    assert got.keys() == STRAINS.keys() and all("ann@example.org" not in t and t.endswith(".org") for t in got.values())
    # one of a megabyte, whole
    one = pii.pseudonymise(spark.createDataFrame([(1, STRAINS["labels"])], "doc_id long, text string")).first()
    assert one.text == STRAINS["labels"]


def test_mail_addresses_that_are_found(spark):
    yes = ["a@b.co", "A.b+c%d@x-y.example.museum", "a@1.2.io", "x@" + "a." * 120 + "com"]
    no = ["a@b", "a@b.c", "@b.co", "a@.co", "a@b..", "x@" + "a." * 200 + "com"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", F.regexp_extract("t", f"({pii.MAIL})", 1).alias("m"))
    got = {r.t: r.m for r in df.collect()}
    assert [got[t] for t in yes] == yes and [got[t] for t in no] == [""] * len(no)


@pytest.mark.parametrize("ids", ["alike", "null", "few"])
@pytest.mark.parametrize("share", [0.5, 0.25, 1.7])
def test_mix_takes_some_of_repeated_rows(spark, ids, share, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    of = {"alike": lambda i: 1, "null": lambda i: None, "few": lambda i: i % 3}[ids]
    rows = [(of(i), "one two", "en", "src0") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = mixing.mix(df, mixing.tree(), share, seed=2).collect()
    assert sum(r.copies for r in out) == int(100 * share) and all(r.n_tokens == 2 for r in out)
    assert {r.copies for r in out} <= {int(share), int(share) + 1}


def test_mix_is_a_prefix_of_the_order(spark):
    """Documents in the order of their hash are taken until the next doesn't fit, in each leaf, by brute force; repeated rows and texts without tokens among them."""
    rows = [(i % 40 if i % 5 else None, "w " * (i % 4), "en" if i % 3 else None, f"src{i % 2}") for i in range(400)] + [(7, "w w", "en", "src1")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, mixing.tree(), 0.4, {("domain1",): 2.0, ("domain0", "en"): 0.0}, seed=3).collect()
    assert not [r for r in out if r.source == "src0" and r.lang == "en"]
    leaves = {}
    for r in df.withColumn("h", F.xxhash64("text").cast("string")).collect():
        leaves.setdefault((r.lang, r.source), []).append((r.doc_id, r.text, r.h))
    got = Counter((r.lang, r.source, r.doc_id, r.text) for r in out for _ in range(r.copies))
    for (lang, source), docs in leaves.items():
        budget = {r.leaf_budget for r in out if (r.lang, r.source) == (lang, source)}
        if not budget:
            continue
        (budget,) = budget
        whole, left = divmod(budget + 1e-9, sum(len(t.split()) for _, t, _ in docs))
        want = Counter({(lang, source, d, t): 0 for d, t, _ in docs})
        for d, t, h in docs:
            want[lang, source, d, t] += int(whole)
        # buckets of the order are cut by the first digits of its hash
        for _, d, t in sorted(((hashlib.md5(f"3|{int(whole)}|{'' if d is None else d}|{h}".encode()).hexdigest(), d, t) for d, t, h in docs), key=lambda x: x[0]):
            if len(t.split()) > left + 1e-9:
                break
            left -= len(t.split())
            want[lang, source, d, t] += 1
        assert {k: v for k, v in got.items() if k[:2] == (lang, source) and k[3]} == {k: v for k, v in want.items() if k[3] and v}
