"""op9 against Python's re, written from the contract."""

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm import secret_scan
from lacuna.llm.automaton import compile_rules, longest
from lacuna.llm.common import table

SMALL = "/root/testdata/sf0.01"
NAMES = "password|passwd|secret|token|api_?key"
PATTERNS = [
    ("assign", rf"(?ai)({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("github", "gh[opsur]_[A-Za-z0-9]+", 0, 24),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 35),
]
PIECES = ["password", "TOKEN", "secret", "api_key", "ApiKey", "=", ":", " ", "'", '"', "token=token=", "abcdefghijkl", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "é", "日", "eyJ", "aGVsbG8", ".", "-", "ghp_", "xoxb-", "AIza", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "\n", "_", "Z" * 20]


def spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(PATTERNS) for m in re.finditer(p, text) if m.end(g) - m.start(g) >= least)


def row(text):
    found = [(PATTERNS[k][0], a, b) for a, k, b in spans(text or "")]
    base = [f for f in found if f[0] in ("assign", "access", "hex")]
    joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
    return (*[sum(f[0] == k for f in found) for k in ("assign", "access", "hex")], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))


def test_query(spark):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.op9_secret_scan(spark, SMALL).collect()}
    assert got == {r.doc_id: row(r.text) for r in table(spark, SMALL, "documents").collect()}
    assert sum(g[4] != "" for g in got.values()) > 5


def test_any_text():
    draw = random.Random(5)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(draw.choices(PIECES, k=3000)) for _ in range(5)]
    texts += ["a" * 3000 + ".b" * 2 + "c" * 600 + " eyJ" + "d" * 3000 + ".e.f" + "g" * 2000, "x" * 511 + "token=" + "a" * 2000, None, ""]
    held = secret_scan.machines(secret_scan.RULES)
    assert secret_scan.find_spans(held, pa.array(texts), secret_scan.RULES) == [spans(t or "") for t in texts]


def test_long_tokens():
    """A megabyte of one token: no place is tried again and again."""
    held = secret_scan.machines(secret_scan.RULES)
    texts = ["eyJ" * 300_000, "f" * 1_000_000, "Z" * 1_000_000 + ".b.c", "token=" * 150_000]
    assert [len(x) for x in secret_scan.find_spans(held, pa.array(texts), secret_scan.RULES)] == [0, 1, 0, 1]


def test_tables(spark):
    rows = [(1, "token=abcdefghijkl", "a"), (1, "token=abcdefghijkl", "a"), (None, None, None), (2, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("id", F.lit(7))
    got = sorted(((r.doc_id, len(r.spans)) for r in secret_scan.secret_spans(docs).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 0), (None, 0)]
    assert secret_scan.secret_spans(docs.limit(0)).count() == 0


def test_longest():
    dfa = compile_rules(["ab*"], anchored=True)
    assert [longest(dfa, b"xabbbc", i, 6) for i in range(3)] == [-1, 5, -1]
