"""Single, multiple and chained imputation as pyspark.ml estimators.

``fit`` returns a model that holds fitted values and small tables only, so that it
fills tables it was not fitted on, takes part in a ``Pipeline``, and can be
written and loaded. Specifications are Params; strategies of one's own are given
as objects or by the name under which they are registered.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing, observed
from ..functions.scratch import removed, written
from . import cells, regression
from .checks import check_frame, missing_counts, predictors, strategies
from .classifier import MissingnessClassifier
from .strategies import REGISTRY, Ask, Fitted, chosen, fill_all, fit_all, forks, named

TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class _Spec(Params):
    """What single, multiple and chained imputers and their models have in common."""

    strategy = Param(Params._dummy(), "strategy", "a strategy for all columns, a list by position, or a dict by column")
    predictors = Param(Params._dummy(), "predictors", "'all', a column, a list, or a dict by column")
    imp_kwgs = Param(Params._dummy(), "imp_kwgs", "arguments by strategy or, before these, by column")
    key = Param(Params._dummy(), "key", "the columns that identify a row", TypeConverters.toListString)
    order = Param(Params._dummy(), "order", "the columns along which temporal strategies fill", TypeConverters.toListString)
    partition = Param(Params._dummy(), "partition", "the columns whose values each have a series of their own", TypeConverters.toListString)
    seed = Param(Params._dummy(), "seed", "draws depend on it and the key", TypeConverters.toInt)
    visit = Param(Params._dummy(), "visit", "default or left-to-right", TypeConverters.toString)

    def _configure(self, strategy: Any = "default predictive", predictors: Any = "all", imp_kwgs: dict | None = None, key: Iterable[str] = (), order: Iterable[str] = (), partition: Iterable[str] = (), seed: int = 0, visit: str = "default", copy: bool = True) -> None:
        if visit not in ("default", "left-to-right"):
            raise ValueError(f"unknown visit order: {visit}")
        kwargs = {k: {a: named(v) if a in ("num_strategy", "cat_strategy") else v for a, v in (own or {}).items()} for k, own in (imp_kwgs or {}).items()}
        self._set(strategy=named(strategy), predictors=predictors, imp_kwgs=kwargs, key=list(key), order=list(order), partition=list(partition), seed=seed, visit=visit)

    def _get(self, name: str) -> Any:
        return self.getOrDefault(getattr(self, name))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class SingleImputer(Estimator, _Spec, DefaultParamsReadable, DefaultParamsWritable):
    """One pass, column by column, in the order of the strategies. ``key`` names the columns that identify a row: draws depend on them.

    Each column is fitted on the table as it was given to ``fit``. Predictors that
    are missing where a cell is to be filled count as the mean or the most
    frequent value among the rows to be filled. Dates, times and nested columns
    are neither filled nor predictors. ``copy`` is accepted and has no effect.
    """

    def __init__(self, strategy: Any = "default predictive", predictors: Any = "all", imp_kwgs: dict | None = None, key: Iterable[str] = (), order: Iterable[str] = (), partition: Iterable[str] = (), seed: int = 0, visit: str = "default", copy: bool = True):
        super().__init__()
        self._configure(strategy, predictors, imp_kwgs, key, order, partition, seed, visit)

    def _fit(self, df: DataFrame) -> SingleImputerModel:
        return self._fit_spec(df, self._get("predictors"), _checked(df))

    def _fit_spec(self, df: DataFrame, spec: Any, counts: dict[str, int]) -> SingleImputerModel:
        fixed = {*self._get("key"), *self._get("order"), *self._get("partition")}
        columns = [c for c in df.columns if c not in fixed]
        plan = strategies(self._get("strategy"), columns, REGISTRY)
        preds = predictors(spec, columns)
        given, seed = self._get("imp_kwgs"), self._get("seed")
        names, asks = {}, {}
        for i, c in enumerate([c for c in plan if counts[c]]):
            names[c], kwargs = chosen(df, c, plan[c], {**given.get(plan[c], {}), **given.get(c, {})})
            simple = not REGISTRY[names[c]].predictive
            asks[c] = Ask(c, tuple(regression.usable(df, preds[c])), tuple(self._get("key") or columns), tuple(self._get("order")), tuple(self._get("partition")), seed + (0 if simple else i), kwargs)
        model = SingleImputerModel(columns, list(fit_all(df, asks, names).values()))
        model._set(**{p.name: self.getOrDefault(p) for p in self.params})
        return model._of(df)


def _checked(df: DataFrame) -> dict[str, int]:
    """Missing cells by column; ValueError for a column without a value, and for missing dates and times. One aggregate."""
    n = missing_counts(check_frame(df))
    gone = [c for c in df.columns if n[c] == n[""]]
    if gone:
        raise ValueError(f"all values missing in {gone}")
    if any(n[c] for c in df.columns if isinstance(df.schema[c].dataType, TIMES)):
        raise ValueError("missing values in a date or timestamp column")
    return n


class _Writer(MLWriter):
    """Params and fitted values as metadata, and fitted tables as Parquet, each once."""

    def __init__(self, instance: Any):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        fits, tables = self.instance._fits(), []
        state = []
        for group in fits:
            own = []
            for f in group:
                places = {}
                for name, df in f.tables.items():
                    if not any(df is t for t in tables):
                        tables.append(df)
                    places[name] = next(i for i, t in enumerate(tables) if t is df)
                own.append({**f.state(), "tables": places})
            state.append(own)
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"columns": self.instance.columns_, "fits": json.dumps(state)})
        for i, df in enumerate(tables):
            df.write.parquet(f"{path}/tables/{i}")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Any:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        read: dict[int, DataFrame] = {}
        groups = []
        for group in json.loads(meta["fits"]):
            own = []
            for state in group:
                tables = {}
                for name, i in state["tables"].items():
                    if i not in read:
                        read[i] = self.sparkSession.read.parquet(f"{path}/tables/{i}")
                    tables[name] = read[i]
                own.append(Fitted.of(state, tables))
            groups.append(own)
        out = self.cls._from(meta["columns"], groups)
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out._of(None)


class _Fitted(Model, _Spec, MLReadable, MLWritable):
    columns_: list[str]
    #: The table of the fit; a loaded model has none.
    source_: DataFrame | None = None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _of(self, df: DataFrame | None) -> Any:
        self.source_ = df
        return self

    def _has_columns(self, df: DataFrame) -> None:
        lost = set(self.columns_) - set(check_frame(df).columns)
        if lost:
            raise ValueError(f"columns of the fit are absent: {sorted(lost)}")

    def imputed_(self, df: DataFrame) -> DataFrame:
        """The cells of df that transform fills: (column, key), one row each."""
        self._has_columns(df)
        return cells.missing_cells(df, self.statistics_, self._get("key"))


class SingleImputerModel(_Fitted):
    """A fitted single imputation. ``statistics_``: the strategy by column; ``fits_``: what they learned."""

    def __init__(self, columns: list[str] = (), fits: list[Fitted] = ()):
        super().__init__()
        self.columns_, self.fits_ = list(columns), list(fits)

    @classmethod
    def _from(cls, columns: list[str], groups: list[list[Fitted]]) -> SingleImputerModel:
        return cls(columns, groups[0])

    def _fits(self) -> list[list[Fitted]]:
        return [self.fits_]

    @property
    def statistics_(self) -> dict[str, str]:
        return {f.ask.column: f.strategy for f in self.fits_}

    def _transform(self, df: DataFrame) -> DataFrame:
        self._has_columns(df)
        return fill_all(df, self.fits_)

    def reseeded(self, seed: int) -> SingleImputerModel:
        """The same fit with other draws; passes over data only for strategies of one's own."""
        moved = seed - self._get("seed")
        out = SingleImputerModel(self.columns_, [f.reseeded(self.source_, f.ask.seed + moved) for f in self.fits_])
        out._set(**{p.name: self.getOrDefault(p) for p in self.params})
        return out._set(seed=seed)._of(self.source_)


class _Several(_Spec):
    n = Param(Params._dummy(), "n", "the number of imputations", TypeConverters.toInt)
    return_list = Param(Params._dummy(), "return_list", "whether each() returns a list or yields", TypeConverters.toBoolean)


class MultipleImputer(Estimator, _Several, DefaultParamsReadable, DefaultParamsWritable):
    """n imputations with seeds of their own, as one long table with ``imp_num`` from 1.

    The table is validated and fitted once; imputations differ in their draws
    alone. ``predictors`` may be a list of n specifications (dicts, lists or
    'all'), each of which is a fit of its own.
    """

    def __init__(self, n: int = 5, seed: int = 0, return_list: bool = False, **single: Any):
        super().__init__()
        if isinstance(n, bool) or not isinstance(n, int):
            raise TypeError("n is a whole number")
        if n < 1:
            raise ValueError("n is at least 1")
        self._configure(seed=seed, **single)
        self._set(n=n, return_list=return_list)

    def _specs(self) -> list[Any]:
        spec, n = self._get("predictors"), self._get("n")
        several = isinstance(spec, (list, tuple)) and len(spec) == n and any(not isinstance(s, str) for s in spec)
        return list(spec) if several else [spec] * n

    def _fit(self, df: DataFrame) -> MultipleImputerModel:
        counts, done, models = _checked(df), [], []
        for i, spec in enumerate(self._specs()):
            seed = self._get("seed") + 1 + 13 * i
            known = next((m for s, m in done if s == spec), None)
            if known is None:
                one = SingleImputer(*[self._get(p) for p in ("strategy", "predictors", "imp_kwgs", "key", "order", "partition")], seed=seed, visit=self._get("visit"))
                known = one._fit_spec(df, spec, counts)
                done.append((spec, known))
            models.append(known.reseeded(seed) if known._get("seed") != seed else known)
        return self._model(models)._of(df)

    def _model(self, models: list[SingleImputerModel]) -> MultipleImputerModel:
        out = MultipleImputerModel(models[0].columns_, models)
        out._set(**{p.name: self.getOrDefault(p) for p in self.params})
        return out


class MultipleImputerModel(_Fitted, _Several):
    def __init__(self, columns: list[str] = (), models: list[SingleImputerModel] = ()):
        super().__init__()
        self.columns_, self.models_ = list(columns), list(models)

    @classmethod
    def _from(cls, columns: list[str], groups: list[list[Fitted]]) -> Any:
        return cls(columns, [SingleImputerModel(columns, g) for g in groups])

    def _of(self, df: DataFrame | None) -> Any:
        for i, m in enumerate(self.models_):
            m._set(**{p.name: self._get("seed") + 1 + 13 * i if p.name == "seed" else self._get(p.name) for p in m.params})
        return super()._of(df)

    def _fits(self) -> list[list[Fitted]]:
        return [m.fits_ for m in self.models_]

    @property
    def statistics_(self) -> dict[str, str]:
        return self.models_[0].statistics_

    def each(self, df: DataFrame) -> list[DataFrame] | Iterator[DataFrame]:
        """The imputations one by one, without imp_num."""
        found = (m.transform(df) for m in self.models_)
        return list(found) if self._get("return_list") else found

    def datasets(self, df: DataFrame) -> Iterator[tuple[int, DataFrame]] | list[tuple[int, DataFrame]]:
        """(imp_num, table) of each imputation."""
        found = enumerate(self.each(df), 1)
        return list(found) if self._get("return_list") else found

    def _transform(self, df: DataFrame) -> DataFrame:
        self._has_columns(df)
        return reduce(DataFrame.unionByName, [m.transform(df).select(F.lit(i + 1).alias("imp_num"), "*") for i, m in enumerate(self.models_)])


class _Chained(_Several):
    k = Param(Params._dummy(), "k", "the number of rounds", TypeConverters.toInt)
    chained = Param(Params._dummy(), "chained", "whether a round's predictions see what it has filled so far and, elsewhere, the round before", TypeConverters.toBoolean)


class MiceImputer(MultipleImputer, _Chained):
    """Chained imputation: k rounds, each fitted on the observed targets and the predictors that the round before completed.

    All imputations are one long table. A round fits every column of all
    imputations at once: one aggregate of means and one of sums of products,
    grouped by imp_num; and it fills each column in one projection. A round is
    written to the shared folder before the next.

    By default a round then fills the table as it was given, column after
    column: predictors later in the order are missing and count as a mean. With
    ``chained`` they have their values of the round before (a column is fitted
    on what the round has filled so far). Univariate and temporal strategies
    are fitted on observed cells and don't depend on other columns: later
    rounds keep their cells. Logistic strategies and one's own are fitted one
    imputation after another.

    What was missing goes along as a column, so rows need no key of their own:
    null and repeated ones stay.
    """

    def __init__(self, k: int = 3, n: int = 5, seed: int = 0, chained: bool = False, return_list: bool = False, **single: Any):
        super().__init__(n, seed, return_list, **single)
        if isinstance(k, bool) or not isinstance(k, int):
            raise TypeError("k is a whole number")
        if k < 1:
            raise ValueError("k is at least 1")
        self._set(k=k, chained=chained)

    def _model(self, models: list[SingleImputerModel]) -> MiceImputerModel:
        out = MiceImputerModel(models[0].columns_, models)
        out._set(**{p.name: self.getOrDefault(p) for p in self.params})
        return out


def _value(df: DataFrame, column: str, mark: str):
    """The cell unless it was missing at first."""
    return F.when(~F.col(f"{mark}.`{column}`"), observed(df, column))


class MiceImputerModel(MultipleImputerModel, _Chained):
    def each(self, df: DataFrame) -> list[DataFrame] | Iterator[DataFrame]:
        long = self.transform(df)
        found = (long.where(F.col("imp_num") == i + 1).drop("imp_num") for i in range(len(self.models_)))
        return list(found) if self._get("return_list") else found

    def _transform(self, df: DataFrame) -> DataFrame:
        self._has_columns(df)
        spark, first = df.sparkSession, self.models_[0]
        again = [f for f in first.fits_ if REGISTRY[f.strategy].predictive]
        if self._get("k") == 1 or not again:
            return super()._transform(df)
        marked = df.withColumn("__was", F.struct(*[is_missing(df, c).alias(c) for c in first.statistics_]))
        done = reduce(DataFrame.unionByName, [m.transform(marked).select(F.lit(i + 1).alias("imp_num"), "*") for i, m in enumerate(self.models_)])
        path = None
        for r in range(1, self._get("k")):
            before = path
            done, path = written(done, "round")
            if before:
                removed(spark, before)
            done = self._chained(done, again, r) if self._get("chained") else self._round(done, again, r)
        return done.select("imp_num", *[f"`{c}`" for c in df.columns])

    def _grouped(self, column: str) -> bool:
        """Whether the column's fits of all imputations come from one aggregate."""
        fits = [self._fit_of(i, column) for i in range(len(self.models_))]
        alike = len({f.ask.predictors for f in fits}) == 1
        return alike and all(f.strategy in regression.STRATEGIES and "fit" in f.params[None] for f in fits)

    def _fit_of(self, i: int, column: str) -> Fitted:
        return next(f for f in self.models_[i].fits_ if f.ask.column == column)

    def _seeds(self, column: str, j: int, r: int) -> dict[int, int]:
        return {i + 1: m._get("seed") + 1000 * r + j for i, m in enumerate(self.models_)}

    def _learn(self, done: DataFrame, column: str, j: int, r: int, models: dict[Any, regression.Linear] | None = None) -> tuple[dict, dict[str, DataFrame]]:
        one = self._fit_of(0, column)
        source = done.withColumn(column, _value(done, column, "__was"))
        return regression.fit(source, column, one.strategy, list(one.ask.predictors), list(one.ask.key), self._seeds(column, j, r), by="imp_num", models=models, **one.ask.kwargs)

    def _one_by_one(self, base: DataFrame, done: DataFrame, column: str, j: int, r: int) -> DataFrame:
        out = []
        for i in range(len(self.models_)):
            f = self._fit_of(i, column)
            of = lambda d, i=i: d.where(F.col("imp_num") == i + 1)
            ask = replace(f.ask, seed=self._seeds(column, j, r)[i + 1])
            source = of(done).withColumn(column, _value(done, column, "__was"))
            out.append(REGISTRY[f.strategy].fill(of(base), ask, *REGISTRY[f.strategy].fit(source, ask)))
        return reduce(DataFrame.unionByName, out)

    def _round(self, done: DataFrame, again: list[Fitted], r: int) -> DataFrame:
        """Fit all columns on the completed table, then fill the table as it was given."""
        at = {c: j for j, c in enumerate(self.statistics_)}
        names = {f.ask.column for f in again}
        held = [c for c in self.statistics_ if c not in names]
        together = {f.ask.column: list(f.ask.predictors) for f in again if self._grouped(f.ask.column)}
        seen = {c: ~F.col(f"__was.`{c}`") for c in together}
        models = regression.many_fits(done, together, "imp_num", where=seen) if together else {}
        keep = F.struct(*[F.col(f"`{c}`").alias(c) for c in held]) if held else F.lit(None)
        base = done.withColumn("__kept", keep)
        for c in self.statistics_:
            base = base.withColumn(c, _value(base, c, "__was"))
        for c in self.statistics_:
            if c in held:
                base = base.withColumn(c, F.col(f"__kept.`{c}`"))
            elif c in together:
                base = regression.apply(base, c, *self._learn(done, c, at[c], r, models[c]), list(self._fit_of(0, c).ask.key), self._seeds(c, at[c], r), "imp_num")
            else:
                base = self._one_by_one(base, done, c, at[c], r)
            base = self._settled(base, c)
        return base.drop("__kept")

    def _chained(self, done: DataFrame, again: list[Fitted], r: int) -> DataFrame:
        """Fit and fill column after column, each on what stands by then."""
        at = {c: j for j, c in enumerate(self.statistics_)}
        for f in again:
            c = f.ask.column
            base = done.withColumn(c, _value(done, c, "__was"))
            if self._grouped(c):
                done = regression.apply(base, c, *self._learn(done, c, at[c], r), list(f.ask.key), self._seeds(c, at[c], r), "imp_num")
            else:
                done = self._one_by_one(base, done, c, at[c], r)
            done = self._settled(done, c)
        return done

    def _settled(self, df: DataFrame, column: str) -> DataFrame:
        """Written, where the column's fill read its table more than once."""
        strategy = self._fit_of(0, column).strategy
        return written(df, "filled")[0] if REGISTRY[strategy].predictive and (forks(strategy) or not self._grouped(column)) else df


__all__ = ["MiceImputer", "MiceImputerModel", "MissingnessClassifier", "MultipleImputer", "MultipleImputerModel", "SingleImputer", "SingleImputerModel"]
