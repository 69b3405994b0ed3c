"""Validation of inputs and of strategy and predictor specifications."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing


def check_frame(df: object) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    return df


def missing_counts(df: DataFrame) -> dict[str, int]:
    """Missing cells by column, and all rows under ''; one aggregate."""
    row = df.agg(F.count(F.lit(1)), *[F.count_if(is_missing(df, c)) for c in df.columns]).first()
    return dict(zip(["", *df.columns], row))


def check_nan_columns(df: DataFrame) -> DataFrame:
    """ValueError that lists the columns in which every cell is missing."""
    n = missing_counts(check_frame(df))
    gone = [c for c in df.columns if n[c] == n[""]]
    if gone:
        raise ValueError(f"all values missing in {gone}")
    return df


def check_missingness(df: DataFrame) -> DataFrame:
    """ValueError if all cells are missing or any cell of a date or timestamp column is."""
    n = missing_counts(check_frame(df))
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if plain and all(n[c] == n[""] for c in plain):
        raise ValueError("all values missing")
    if any(n[c] for c in df.columns if c not in plain):
        raise ValueError("missing values in a date or timestamp column")
    return df


def drop_nan_columns(df: DataFrame) -> DataFrame:
    n = missing_counts(df)
    return df.drop(*[c for c in df.columns if n[c] == n[""]])


def strategies(spec: str | Iterable[str] | dict[str, str], columns: list[str], known: Iterable[str]) -> dict[str, str]:
    """A name for all columns, a list by position or a partial dict, as a dict."""
    if isinstance(spec, str):
        found = dict.fromkeys(columns, spec)
    elif isinstance(spec, dict):
        if set(spec) - set(columns):
            raise ValueError(f"no such columns: {sorted(set(spec) - set(columns))}")
        found = dict(spec)
    elif isinstance(spec, (list, tuple)):
        if len(spec) != len(columns):
            raise ValueError(f"{len(spec)} strategies for {len(columns)} columns")
        found = dict(zip(columns, spec))
    else:
        raise TypeError("strategies are a name, a list, a tuple or a dict")
    unknown = set(found.values()) - set(known)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    return found


def predictors(spec: str | list | dict, columns: list[str]) -> dict[str, list[str]]:
    """Predictors by column; 'all' is every other column."""
    if isinstance(spec, (list, tuple)) and len(spec) == len(columns):
        spec = dict(zip(columns, spec))
    if not isinstance(spec, dict):
        spec = dict.fromkeys(columns, spec)
    if set(spec) - set(columns):
        raise ValueError(f"no such columns: {sorted(set(spec) - set(columns))}")
    out = {}
    for c in columns:
        use = spec.get(c, "all")
        use = [x for x in columns if x != c] if use == "all" else [use] if isinstance(use, str) else list(use)
        if set(use) - set(columns):
            raise ValueError(f"no such predictors: {sorted(set(use) - set(columns))}")
        out[c] = use
    return out


def listwise_delete(df: DataFrame, verbose: bool = False) -> DataFrame:
    """Rows without a missing cell."""
    check_nan_columns(df)
    kept = df.where(~reduce(lambda a, b: a | b, [is_missing(df, c) for c in df.columns]))
    if verbose:
        print(f"rows before: {df.count()}, after: {kept.count()}")
    return kept
