"""Chat formatting: role repair of least cost over an automaton of legal turns.

Legal is an optional system turn, then user and assistant in turn, ending with
the assistant. A turn may be kept, relabelled, or merged into the turn before
it; empty turns may be inserted. Each turn is a matrix of costs from state to
state, and costs along a conversation combine by (min, +), which is associative:
a conversation is cut into segments, whose matrices are chained, and each
segment is then walked back between the states found for its ends. So a long
conversation is spread over tasks; only 16 numbers of each segment of about
SEGMENT turns come together.

Cases: null and unknown roles are relabelled at RELABEL_UNKNOWN; null texts
count as empty; repeated rows of a turn are one turn, with ``copies`` counted;
different rows of one turn number go by a hash of role and text; null turn
numbers come first; null ids are one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEGMENT = 256
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the roles.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
NEVER = 1 << 40


def step(before: int, role: int) -> tuple[int, list[int]]:
    """Cost of a turn of ``role`` after state ``before``, and the roles of empty turns inserted ahead of it."""
    if before == role:
        return MERGE, []
    if role == SYSTEM:
        return (0, []) if before == START else (NEVER, [])
    if role == USER:
        return 0, []
    return (0, []) if before == USER else (INSERT, [USER])


CLOSE = {START: (0, []), SYSTEM: (2 * INSERT, [USER, ASSISTANT]), USER: (INSERT, [ASSISTANT]), ASSISTANT: (0, [])}
_STEP = np.full((4, 4), NEVER, np.int64)
for _a in range(4):
    for _b in NAMES:
        _STEP[_a, _b] = step(_a, _b)[0]
_TURN = {}
for _r in (None, SYSTEM, USER, ASSISTANT):
    _m = _STEP.copy()
    for _b in NAMES:
        _m[:, _b] += 0 if _b == _r else RELABEL_UNKNOWN if _r is None else RELABEL
    _TURN[_r] = _m


def role_of(name: str | None) -> int | None:
    return ROLES.get((name or "").strip().lower())


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def walk(matrices: list[np.ndarray], entry: int, leave: int | None = None) -> tuple[int, list[int]]:
    """Least cost and the state after each matrix. Without ``leave`` the cost of closing counts, and picks the end; ties go to the smaller state."""
    cost = np.full(4, NEVER, np.int64)
    cost[entry] = 0
    back = []
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), NEVER)
    if leave is None:
        closed = cost + np.array([CLOSE[s][0] for s in range(4)])
        leave = int(closed.argmin())
        best = int(closed[leave])
    else:
        best = int(cost[leave])
    states, s = [], leave
    for b in reversed(back):
        states.append(s)
        s = int(b[s])
    return best, states[::-1]


def _matrix(roles: pd.Series) -> pd.Series:
    def one(names):
        m = _TURN[role_of(names[0])]
        for n in names[1:]:
            m = times(m, _TURN[role_of(n)])
        return m.ravel()

    return roles.map(one)


def _chain(matrices: pd.Series) -> pd.DataFrame:
    out = []
    for held in matrices:
        cost, states = walk([np.array(m, np.int64).reshape(4, 4) for m in held], START)
        out.append((cost, [START, *states[:-1]], states))
    return pd.DataFrame(out, columns=["cost", "entry", "leave"])


def _repair(roles: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    out = []
    for names, s, end in zip(roles, entry, leave):
        own = [role_of(n) for n in names]
        rows = []
        for r, t in zip(own, walk([_TURN[r] for r in own], int(s), int(end))[1]):
            rows.append({"before": [NAMES[x] for x in step(s, t)[1]], "role": NAMES[t], "merged": bool(s == t), "relabelled": bool(r != t)})
            s = t
        out.append(rows)
    return pd.Series(out)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment: conv_id, segment, n_turns, n_copies, n_merged, n_relabelled, n_inserted, cost (of the whole conversation) and rendered.

    The rendered segments of a conversation, joined in order, are its text:
    each turn is "<|role|>" and a line break, its text, and a line break.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.coalesce("role", F.lit("")), "text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    # blocks in which turn numbers repeat too often are cut finer, in the same order
    crowded = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * SEGMENT)
    crowded = crowded.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "n")
    point = F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    placed = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    seg = F.struct("block", F.when(F.col("n").isNotNull(), F.col("turn")).alias("turn"), F.when(F.col("n").isNotNull(), F.floor(point * F.col("n") / SEGMENT)).alias("part"))
    one = F.struct("turn", "h", "role", "text", "copies")
    held = materialize(placed.groupBy("conv_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(one)).alias("turns")).withColumn("matrix", F.pandas_udf(_matrix, "array<long>")(F.col("turns.role"))), "segments")
    chain = held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "matrix"))).alias("s")).withColumn("r", F.pandas_udf(_chain, "struct<cost:long,entry:array<int>,leave:array<int>>")(F.col("s.matrix")))
    ends = chain.select(F.col("conv_id").alias("c"), F.col("r.cost").alias("cost"), F.size("s").alias("n_segments"), F.posexplode(F.arrays_zip(F.col("s.seg").alias("sg"), F.col("r.entry").alias("entry"), F.col("r.leave").alias("leave"))).alias("k", "z"))
    ends = ends.select("c", "cost", "n_segments", "k", F.col("z.sg").alias("sg"), F.col("z.entry").alias("entry"), F.col("z.leave").alias("leave"))
    both = held.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg").eqNullSafe(F.col("sg"))))
    fixed = both.withColumn("fix", F.pandas_udf(_repair, "array<struct<before:array<string>,role:string,merged:boolean,relabelled:boolean>>")(F.col("turns.role"), F.col("entry"), F.col("leave")))
    empty = lambda names: F.array_join(F.transform(names, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n\n"))), "")
    body = F.transform(F.arrays_zip(F.col("turns").alias("t"), F.col("fix").alias("f")), lambda z: F.concat(empty(z["f"]["before"]), F.when(z["f"]["merged"], F.lit("")).otherwise(F.concat(F.lit("<|"), z["f"]["role"], F.lit("|>\n"))), z["t"]["text"], F.lit("\n")))
    last = F.col("k") == F.col("n_segments") - 1
    closing = F.array(*[F.array(*[F.lit(NAMES[r]) for r in CLOSE[s][1]]).cast("array<string>") for s in range(4)])
    close = F.when(last, F.element_at(closing, F.col("leave") + 1)).otherwise(F.array().cast("array<string>"))
    count = lambda name: F.size(F.filter("fix", lambda f: f[name])).cast("long")
    return fixed.select(
        "conv_id", F.col("k").cast("long").alias("segment"), F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["copies"]).alias("n_copies"),
        count("merged").alias("n_merged"), count("relabelled").alias("n_relabelled"),
        (F.aggregate("fix", F.lit(0), lambda s, f: s + F.size(f["before"])) + F.size(close)).cast("long").alias("n_inserted"),
        "cost", F.concat(F.array_join(body, ""), empty(close)).alias("rendered"),
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repair(table(spark, sf_dir, "conversations"))
