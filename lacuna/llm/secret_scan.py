"""Secret scans: all rules in one pass over the bytes, by one automaton.

The rules' expressions are compiled together (``automaton``) and turned, so that
one pass over a block's bytes, from the last to the first, gives every place
where a match of any rule begins. From the leftmost of these, and then from the
leftmost at or after the end found, the rule's own anchored automaton gives the
longest match; of no rule a byte is read twice. Ends and starts are code points.

In all rules the longest match is the one that a backtracking matcher finds:
no repetition can give back a character to what follows it.

Cases: null and empty texts have no spans; the hash of no spans is that of the
empty string; repeated rows keep a row each; an empty table gives an empty
result. Texts of any length are scanned whole, in time linear in their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules, longest, scan
from .common import blocks, buffer_of


@dataclass(frozen=True)
class Rule:
    """Matches of head and pattern, leftmost and without overlap, are candidates; those pass whose part after the head has ``least`` bytes."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    base: bool = False


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_NAMES = _either_case("password|passwd|secret|token|api_?key")
RULES = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 12, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?", True),
    Rule("access", "AKIA[A-Z0-9]+", 18, base=True),
    # runs of 16 at least: the same matches, and not a start for each letter of a text
    Rule("hex", "[0-9a-f]{16}[0-9a-f]*", 16, base=True),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 35),
)


@dataclass(frozen=True)
class Machines:
    """The turned automaton of all rules, and for each its anchored ones: of the whole and of the head."""

    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


@cache
def machines(rules: tuple[Rule, ...]) -> Machines:
    whole = [r.head + r.pattern for r in rules]
    return Machines(
        compile_rules(whole, backward=True),
        tuple(compile_rules([x], anchored=True) for x in whole),
        tuple(compile_rules([r.head], anchored=True) if r.head else None for r in rules),
    )


def find_spans(held: Machines, texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, rule, end) of all spans, by start, then rule."""
    data, offsets = buffer_of(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    back, bits = scan(held.starts, data[::-1], (len(data) - offsets)[::-1])
    if not len(back):
        return found
    order = np.argsort(-back)
    at, bits = len(data) - 1 - back[order], bits[order]
    raw = data.tobytes()
    for k, rule in enumerate(rules):
        begins = at[bits >> k & 1 == 1]
        docs = np.searchsorted(offsets, begins, side="right") - 1
        i = 0
        while i < len(begins):
            a, d = int(begins[i]), int(docs[i])
            stop = int(offsets[d + 1])
            b = longest(held.whole[k], raw, a, stop)
            head = longest(held.heads[k], raw, a, stop) - a if held.heads[k] else 0
            if b - a - head >= rule.least:
                found[d].append((a, k, b))
            i = int(np.searchsorted(begins, b))
    for d in {d for d, spans in enumerate(found) if spans}:
        low = int(offsets[d])
        # code points before each byte
        count = np.concatenate([[0], np.cumsum((data[low : offsets[d + 1]] & 0xC0) != 0x80)])
        found[d] = sorted((int(count[a - low]), k, int(count[b - low])) for a, k, b in found[d])
    return found


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and spans, an array of (kind, start_at, end_at, base), by start, then kind as listed."""
    held = machines(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("base", pa.bool_())]))
        for batch in blocks(batches, "text"):
            found = find_spans(held, batch.column("text"), rules)
            rows = [[{"kind": rules[k].kind, "start_at": a, "end_at": b, "base": rules[k].base} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{id_col} long, spans array<struct<kind:string, start_at:long, end_at:long, base:boolean>>")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start_at"], s["end_at"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
