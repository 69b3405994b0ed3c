"""Driver tables with cells nulled by a fixed rule of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (a, b, t): a cell is nulled when its key's hash is below t of 1,000,003.
MASKS = {
    "orders": ("o_orderkey", {"o_totalprice": (48271, 11, 200001), "o_orderstatus": (69621, 7, 150000), "o_orderpriority": (16807, 3, 100000)}),
    "customer": ("c_custkey", {"c_acctbal": (48271, 11, 200001), "c_mktsegment": (69621, 7, 150000)}),
    "events": ("event_id", {"value": (48271, 11, 200001), "event_type": (69621, 7, 150000)}),
    "lineitem": ("l_key", {"l_quantity": (48271, 11, 200001), "l_extendedprice": (69621, 7, 150000), "l_discount": (16807, 3, 100000)}),
}
#: Keys that are made of other columns.
KEYS = {"l_key": "(l_orderkey * 8 + l_linenumber)"}
P = 1000003


def _cell(name: str, key: str, a: int, b: int, t: int, other: str = "") -> str:
    h1 = f"(({key} % {P} * {a} + {b}) % {P})"
    h2 = f"(({h1} * {h1} + {a}) % {P})"
    return f"CASE WHEN ({h2} * {h2} + {b}) % {P} >= {t} THEN {name} {other}END AS {name}"


def masked_sql(table: str, *keep: str) -> str:
    key, cells = MASKS[table]
    own = KEYS.get(key, key)
    return f"SELECT {', '.join([f'{own} AS {key}' if own != key else key, *keep, *[_cell(c, own, *abt) for c, abt in cells.items()]])} FROM {table}"


def masked(spark: SparkSession, sf_dir: str, table: str, *keep: str, nan: bool = False) -> DataFrame:
    """The key, ``keep`` and the masked columns; with ``nan``, missing doubles are NaN instead of null."""
    key, cells = MASKS[table]
    own = KEYS.get(key, key)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    other = lambda c: "ELSE CAST('NaN' AS DOUBLE) " if nan and df.schema[c].dataType.typeName() == "double" else ""
    return df.select(F.expr(own).alias(key), *keep, *[F.expr(_cell(c, own, *abt, other(c))) for c, abt in cells.items()])
