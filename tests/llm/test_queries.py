"""Registered queries over the small tables against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest
import regex

pytest.importorskip("lacuna.llm")
from lacuna.llm import chat_format, mixing, pii, repeats, token_counts, toxicity  # noqa: E402
from lacuna.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}


def cheapest(roles):
    """The least cost of a repair, state by state."""
    best = {chat_format.START: 0}
    for role in map(chat_format.role_of, roles):
        after = {}
        for s, cost in best.items():
            for t in chat_format.NAMES:
                c = cost + chat_format.step(s, t)[0] + (0 if role == t else chat_format.RELABEL_UNKNOWN if role is None else chat_format.RELABEL)
                after[t] = min(c, after.get(t, c))
        best = after
    return min(c + chat_format.CLOSE[s][0] for s, c in best.items())


def test_op1(spark):
    turns = defaultdict(list)
    for r in table(spark, SMALL, "conversations").collect():
        turns[r.conv_id].append((r.turn, hashlib.md5(f"{r.role or ''}|{r.text or ''}".encode()).hexdigest(), r.role))
    got = {}
    for r in chat_format.op1_chat_format(spark, SMALL).collect():
        got[r.conv_id] = r.cost
    assert got == {c: cheapest([role for *_, role in sorted(set(t), key=lambda x: x[:2])]) for c, t in turns.items()}


def test_op2(spark, corpus):
    first, raws = {}, {d: (r.text or "").encode() for d, r in corpus.items()}
    for d in sorted(raws):
        for i in range(len(raws[d]) - 49):
            first.setdefault(raws[d][i : i + 50], d)
    for r in repeats.op2_repeats(spark, SMALL).collect():
        raw, gone, end, spans = raws[r.doc_id], bytearray(len(raws[r.doc_id])), -1, 0
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < r.doc_id:
                gone[max(i, end) : i + 50] = b"\1" * (i + 50 - max(i, end))
                spans += i > end
                end = i + 50
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())


def test_op3(spark, corpus):
    """Every entity is replaced, nothing else is; one unit has one surrogate in all documents, and no two share one."""
    found = regex.compile(pii.ANY.replace("(?<sep>", "(?P<sep>").replace(r"\k<sep>", "(?P=sep)"))
    given, count = {}, defaultdict(int)
    for r in pii.op3_pii(spark, SMALL).collect():
        text = corpus[r.doc_id].text
        if text is None:
            assert r.text is None
            continue
        at, rest = 0, r.text
        mentions = [m.group(0) for m in found.finditer(text)]
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == len(mentions)
        # the text between entities stays, and what stands between is as many entities
        gaps, last = [], 0
        for m in found.finditer(text):
            gaps.append(text[last : m.start()])
            last = m.end()
        gaps.append(text[last:])
        new = [m.group(0) for m in found.finditer(rest)]
        if len(new) == len(mentions):
            assert "".join(g + s for g, s in zip(gaps, [*new, ""])) == rest
            for old, made in zip(mentions, new):
                assert old != made
                unit = old.lower() if "@" in old else regex.sub(r"\D", "", old)[-10:] if regex.sub(r"\D", "", old) and len(regex.sub(r"\D", "", old)) != 16 and "." not in old else old
                key = (made.lower() if "@" in made else regex.sub(r"\D", "", made)[-10:] if unit != old else made)
                assert given.setdefault(unit, key) == key
                count[unit] += 1
        else:  # a surrogate may join what stands next to it
            assert not mentions or rest != text
    assert len(count) > 10 and len(set(given.values())) == len(given)


def poured(total, children):
    """total split by weight, no child above its capacity; (capacity, weight) by child."""
    out, left, open_ = {}, total, dict(children)
    while open_:
        share = left / sum(w for _, w in open_.values())
        full = {c: cap for c, (cap, w) in open_.items() if cap <= share * w + 1e-9}
        if not full:
            return out | {c: share * w for c, (_, w) in open_.items()}
        out |= full
        left -= sum(full.values())
        open_ = {c: v for c, v in open_.items() if c not in full}
    return out


def test_op4(spark, corpus):
    """Budgets down the tree by pouring, and each leaf within a document of its budget."""
    tokens = defaultdict(int)
    for r in corpus.values():
        number = regex.search(r"(\d+)$", r.source or "")
        tokens[f"domain{int(number.group(1)) % 3 if number else 0}", r.lang, r.source] += len((r.text or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    weight = {("domain0",): 2.0, ("domain1", "en"): 3.0}
    budgets = {(): sum(tokens.values()) * 0.5}
    for depth in (1, 2, 3):
        below = defaultdict(dict)
        for k, v in tokens.items():
            cap, w = below[k[: depth - 1]].get(k[:depth], (0.0, weight.get(k[:depth], 1.0)))
            below[k[: depth - 1]][k[:depth]] = (cap + v * mixing.MAX_EPOCHS, w)
        budgets = {c: b for p, children in below.items() for c, b in poured(budgets[p], children).items()}
    spent, longest = defaultdict(int), max(len((r.text or "").split()) for r in corpus.values())
    for r in mixing.op4_mixing(spark, SMALL).collect():
        number = regex.search(r"(\d+)$", r.source or "")
        leaf = (f"domain{int(number.group(1)) % 3 if number else 0}", r.lang, r.source)
        assert r.n_tokens == len((corpus[r.doc_id].text or "").split()) and r.leaf_budget == pytest.approx(budgets[leaf], abs=1e-2)
        spent[leaf] += r.n_tokens * r.copies
    assert all(budgets[k] - longest <= spent[k] <= budgets[k] + 1e-3 for k in budgets)


def test_op6(spark, corpus):
    toxic = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    rows = toxicity.op6_toxicity(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labelled = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in labelled) >= 0.8 * len(labelled)


def test_op8(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in token_counts.op8_token_counts(spark, SMALL).collect():
        text = corpus[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
