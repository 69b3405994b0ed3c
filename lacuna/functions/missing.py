"""Column expressions that every operator on missing values shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the column is a float."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def observed(df: DataFrame, name: str) -> Column:
    """The value, or null where it is missing in either way."""
    return F.when(~is_missing(df, name), F.col(f"`{name}`"))


def by_group(values: dict, group: str | None) -> Column:
    """The value of the row's group; without ``group`` the only one there is."""
    if group is None:
        (one,) = values.values()
        return F.lit(one)
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(f"`{group}`"))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def digest(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts' texts, joined by |: a long that any SQL engine with md5 can recompute."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 13), 16, 10).cast("long")


def drawn(seed: int | Column, salt: str, *key: str) -> Column:
    """A whole number in [0, 2^52) that depends on the row's key, not on how rows are partitioned. The seed may be a column."""
    return digest(seed if isinstance(seed, Column) else F.lit(str(seed)), F.lit(salt), *[F.col(k) for k in key])


def uniform(seed: int | Column, salt: str, *key: str) -> Column:
    """A number in (0, 1), by the same rule."""
    return (drawn(seed, salt, *key).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int | Column, salt: str, *key: str) -> Column:
    """A standard normal draw, by the same rule."""
    return F.sqrt(-2 * F.log(uniform(seed, salt + "/r", *key))) * F.cos(2 * math.pi * uniform(seed, salt + "/a", *key))
