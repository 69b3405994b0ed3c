"""Addresses of cells: a long table with a row for each cell, (column, key columns)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing


def addresses(df: DataFrame, marks: dict, key: Iterable[str]) -> DataFrame:
    """A row for each cell whose mark (a boolean Column by column name) holds: the column's name as ``column``, and the row's key.

    One projection: each row lists its cells. Keys should tell rows apart; a repeated key addresses each of its rows.
    """
    key = list(key)
    if not key:
        raise ValueError("cells are addressed by a key: name its columns")
    if "column" in key:
        raise ValueError("no key column may be named column")
    named = [F.when(m, F.lit(c)) for c, m in marks.items()]
    if not named:
        return df.where("false").select(F.lit("").alias("column"), *[f"`{c}`" for c in key])
    return df.select(F.explode(F.array_compact(F.array(*named))).alias("column"), *[f"`{c}`" for c in key])


def missing_cells(df: DataFrame, columns: Iterable[str], key: Iterable[str]) -> DataFrame:
    return addresses(df, {c: is_missing(df, c) for c in columns}, key)


def blanked(df: DataFrame, cells: DataFrame, key: Iterable[str]) -> DataFrame:
    """df with the addressed cells nulled. The cells of a row are listed once, so that rows meet one row each in the join; null keys are keys."""
    key = list(key)
    lists = cells.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)]).agg(F.collect_set("column").alias("__gone"))
    same = [df[f"`{c}`"].eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    gone = lambda c: F.coalesce(F.array_contains("__gone", c), F.lit(False))
    return df.join(lists, same, "left").select(*[F.col(f"`{c}`") if c in key else F.when(~gone(c), F.col(f"`{c}`")).alias(c) for c in df.columns])
