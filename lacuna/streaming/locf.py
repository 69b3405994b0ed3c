"""Last observation carried forward across micro-batches.

Each series' last observed value and its place in the order are the state of its
key; a batch's rows are filled in their order, from the state on. Rows should
come in order: one that is older than what its series has seen is late and
takes the value of rows before it in its own batch only, never a newer one.

Cases: rows before a series' first value get ``start`` (by default they stay
missing: what comes later isn't known yet); NaN counts as missing; a null key is
a series; a batch without a value leaves the state alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.missing import observed


def locf(df: DataFrame, column: str, key: str, order: str, start: Any = None) -> DataFrame:
    """df, streaming or not in order, with ``column`` filled within each ``key`` along ``order`` (a timestamp or number).

    The output mode is append.
    """
    names = df.columns
    kind = df.schema[column].dataType.simpleString()
    if df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        place = F.unix_micros(F.col(f"`{order}`").cast("timestamp"))
    else:
        place = F.col(f"`{order}`").cast("long")

    def fill(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("__at", kind="stable")
        own, out = None, []
        for at, x in zip(rows["__at"], rows[column]):
            late = seen is not None and at < seen
            if x is not None and x == x:
                own = x
            held = own if own is not None else value if not late else None
            out.append(start if held is None else held)
        fresh = rows[rows[column].notna()]
        if len(fresh) and (seen is None or int(fresh["__at"].iloc[-1]) >= seen):
            state.update((fresh[column].iloc[-1], int(fresh["__at"].iloc[-1])))
        rows[column] = pd.Series(out, index=rows.index, dtype=object)
        yield rows[names]

    placed = df.withColumn(column, observed(df, column)).withColumn("__at", place)
    return placed.groupBy(f"`{key}`").applyInPandasWithState(fill, df.schema, f"value {kind}, at long", "append", GroupStateTimeout.NoTimeout)
