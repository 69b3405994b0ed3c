"""What a strategy is: a registry by name, a protocol to fit and fill, and fitted state that can be written.

A strategy of one's own subclasses ``Strategy``, sets ``name``, and is passed
where a name is expected, or registered by ``register``::

    class Midrange(Strategy):
        name = "midrange"

        def fit(self, df, ask):
            x = df.agg(((F.min(ask.column) + F.max(ask.column)) / 2)).first()[0]
            return {"x": x}, {}

        def fill(self, df, ask, params, tables):
            return df.withColumn(ask.column, F.coalesce(ask.column, F.lit(params["x"])))

    SingleImputer({"price": Midrange()})
"""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from ..functions.missing import is_numeric
from ..functions.scratch import written
from . import regression, temporal, univariate


@dataclass(frozen=True)
class Ask:
    """The column to fill, its predictors, the columns that identify and order rows, a seed and the strategy's own arguments."""

    column: str
    predictors: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    partition: tuple[str, ...] = ()
    seed: int = 0
    kwargs: dict[str, Any] = field(default_factory=dict)


class Strategy:
    """Fit on a table, fill a table's missing cells of one column. Instances hold no fitted state."""

    name: str = ""
    #: Whether other columns predict this one; such strategies are refitted in later rounds of chained imputation.
    predictive: bool = False

    def fit(self, df: DataFrame, ask: Ask) -> tuple[dict, dict[str, DataFrame]]:
        """What is learned: values (numbers, strings, dates, and lists and dicts of them) and tables by name."""
        raise NotImplementedError

    def fill(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
        """df with the missing cells of ask.column filled, all rows and columns kept."""
        raise NotImplementedError

    def reseeded(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> tuple[dict, dict[str, DataFrame]]:
        """The same fit for another ask.seed: fitted again, unless a strategy knows better."""
        return self.fit(df, ask)


@dataclass(frozen=True)
class Fitted:
    strategy: str
    ask: Ask
    params: dict
    tables: dict[str, DataFrame]

    def fill(self, df: DataFrame) -> DataFrame:
        return REGISTRY[self.strategy].fill(df, self.ask, self.params, self.tables)

    def reseeded(self, df: DataFrame, seed: int) -> Fitted:
        ask = replace(self.ask, seed=seed)
        return Fitted(self.strategy, ask, *REGISTRY[self.strategy].reseeded(df, ask, self.params, self.tables))

    def state(self) -> dict:
        """All but the tables, as JSON has it."""
        return {"strategy": self.strategy, "ask": _plain(asdict(self.ask)), "params": _plain(self.params), "tables": sorted(self.tables)}

    @classmethod
    def of(cls, state: dict, tables: dict[str, DataFrame]) -> Fitted:
        if state["strategy"] not in REGISTRY:
            raise ValueError(f"register the strategy first: {state['strategy']}")
        ask = {k: tuple(v) if isinstance(v, list) else v for k, v in _back(state["ask"]).items()}
        return cls(state["strategy"], Ask(**ask), _back(state["params"]), tables)


_TYPES = {"date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat, "Decimal": Decimal, "bytes": bytes.fromhex}


def _plain(v: Any) -> Any:
    """Values as JSON has them: dicts as pairs, so that keys may be of any kind, and other types by name."""
    if isinstance(v, dict):
        return {"pairs": [[_plain(k), _plain(x)] for k, x in v.items()]}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if type(v).__name__ in _TYPES:
        return {"type": type(v).__name__, "text": v.hex() if isinstance(v, bytes) else v.isoformat() if hasattr(v, "isoformat") else str(v)}
    raise TypeError(f"a strategy's values are numbers, strings, dates, lists and dicts, not {type(v).__name__}")


def _back(v: Any) -> Any:
    if isinstance(v, dict):
        return {_back(k): _back(x) for k, x in v["pairs"]} if "pairs" in v else _TYPES[v["type"]](v["text"])
    return [_back(x) for x in v] if isinstance(v, list) else v


class _Univariate(Strategy):
    def __init__(self, name: str):
        self.name = name

    def fit(self, df: DataFrame, ask: Ask) -> tuple[dict, dict[str, DataFrame]]:
        return _learned(df, {ask.column: ask}, {ask.column: self.name})[ask.column]

    def fill(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
        return univariate.fill(df, {ask.column: params}, {ask.column: tables.get("weights")}, ask.seed, list(ask.key))

    def reseeded(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> tuple[dict, dict[str, DataFrame]]:
        return univariate.reseeded(ask.column, params, ask.seed), tables


class _Temporal(Strategy):
    def __init__(self, name: str):
        self.name = name

    def fit(self, df: DataFrame, ask: Ask) -> tuple[dict, dict[str, DataFrame]]:
        if not ask.order:
            raise ValueError(f"{self.name} needs columns to order rows by")
        return {}, {}

    def fill(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
        return temporal.fill(df, ask.column, self.name, list(ask.order), list(ask.partition), **ask.kwargs)

    def reseeded(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> tuple[dict, dict[str, DataFrame]]:
        return params, tables


class _Regression(Strategy):
    predictive = True

    def __init__(self, name: str):
        self.name = name

    def fit(self, df: DataFrame, ask: Ask) -> tuple[dict, dict[str, DataFrame]]:
        return regression.fit(df, ask.column, self.name, list(ask.predictors), list(ask.key), ask.seed, **ask.kwargs)

    def fill(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
        return regression.apply(df, ask.column, params, tables, list(ask.key), ask.seed)

    def reseeded(self, df: DataFrame, ask: Ask, params: dict, tables: dict[str, DataFrame]) -> tuple[dict, dict[str, DataFrame]]:
        return regression.reseeded(params, ask.seed, ask.kwargs), tables


REGISTRY: dict[str, Strategy] = {
    **{n: _Univariate(n) for n in univariate.STRATEGIES},
    **{n: _Temporal(n) for n in temporal.STRATEGIES},
    **{n: _Regression(n) for n in regression.STRATEGIES},
}
BUILT_IN = tuple(REGISTRY)


def register(strategy: Strategy | type[Strategy]) -> str:
    """Make a strategy known under its name, which is returned. Built-in names are taken."""
    one = strategy() if isinstance(strategy, type) and issubclass(strategy, Strategy) else strategy
    if not isinstance(one, Strategy):
        raise TypeError(f"not a Strategy: {strategy!r}")
    if not one.name or one.name in BUILT_IN:
        raise ValueError(f"a strategy needs a name of its own, not {one.name!r}")
    for method in ("fit", "fill"):
        if getattr(type(one), method) is getattr(Strategy, method):
            raise TypeError(f"{one.name} has no {method}")
    REGISTRY[one.name] = one
    return one.name


def named(spec: Any) -> Any:
    """A specification with strategies replaced by their names, which are registered."""
    if isinstance(spec, dict):
        return {c: named(v) for c, v in spec.items()}
    if isinstance(spec, (list, tuple)):
        return [named(v) for v in spec]
    if spec is None or isinstance(spec, str):
        return spec
    return register(spec)


def chosen(df: DataFrame, column: str, strategy: str, kwargs: dict) -> tuple[str, dict]:
    """The strategy and arguments for a column: the defaults take num_strategy and cat_strategy, with num_kwgs and cat_kwgs, by the column's type."""
    if not strategy.startswith("default "):
        return strategy, kwargs
    kind = "num" if is_numeric(df, column) else "cat"
    rest = {k: v for k, v in kwargs.items() if k not in ("num_strategy", "cat_strategy", "num_kwgs", "cat_kwgs")}
    own = {**rest, **(kwargs.get(f"{kind}_kwgs") or {})}
    other = kwargs.get(f"{kind}_strategy")
    if other is None:
        return strategy, own
    if other not in REGISTRY:
        raise ValueError(f"unknown strategy: {other}")
    return chosen(df, column, other, own)


def _learned(df: DataFrame, asks: dict[str, Ask], names: dict[str, str]) -> dict[str, tuple[dict, dict[str, DataFrame]]]:
    """Univariate fits of several columns, from one aggregate."""
    seed = next(iter(asks.values())).seed
    params = univariate.fit(df, names, {c: a.kwargs for c, a in asks.items()}, seed)
    return {c: (p, {"weights": w} if (w := univariate.weights(df, c, p)) is not None else {}) for c, p in params.items()}


def fit_all(df: DataFrame, asks: dict[str, Ask], names: dict[str, str]) -> dict[str, Fitted]:
    """Each column's fit; the built-in univariate ones share an aggregate."""
    together = {c: n for c, n in names.items() if isinstance(REGISTRY[n], _Univariate)}
    done = _learned(df, {c: asks[c] for c in together}, together) if together else {}
    for c, n in names.items():
        if c not in done:
            done[c] = REGISTRY[n].fit(df, asks[c])
    return {c: Fitted(names[c], asks[c], *done[c]) for c in names}


def forks(strategy: str) -> bool:
    """Whether a fill reads its table more than once: draws among values, donors, series, and what isn't known."""
    plain = {"mean", "median", "norm", "normal unit variance", *regression.STRATEGIES} - {"pmm", "lrd", "default predictive"}
    return strategy not in plain


def fill_all(df: DataFrame, fits: list[Fitted]) -> DataFrame:
    """Column by column, in order; neighbours in the order that are built-in univariate strategies share a projection.

    A table is written between two fills that each read theirs more than once,
    so that the first one isn't repeated by the second.
    """
    out, waiting, read = df, [], False

    def settled(out: DataFrame) -> DataFrame:
        if not waiting:
            return out
        ask = waiting[0].ask
        return univariate.fill(out, {f.ask.column: f.params for f in waiting}, {f.ask.column: f.tables.get("weights") for f in waiting}, ask.seed, list(ask.key))

    for f in fits:
        if isinstance(REGISTRY[f.strategy], _Univariate):
            waiting.append(f)
            read = read or bool(f.tables)
            continue
        out, waiting = settled(out), []
        if forks(f.strategy):
            if read:
                out = written(out, "filled")[0]
            read = True
        out = f.fill(out)
    return settled(out).select(*[f"`{c}`" for c in df.columns])
