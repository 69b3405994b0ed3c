"""Whether a cell is missing, told from the other columns, and test sets made of cells that look as if they were."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Iterator
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, is_numeric, observed
from ..functions.scratch import removed, written
from . import cells, regression
from .checks import check_frame, missing_counts, predictors

#: Names that a classifier's columns get, where it has them.
OWN = {"featuresCol": "__features", "labelCol": "__label", "probabilityCol": "__probability", "predictionCol": "__prediction", "rawPredictionCol": "__raw"}
#: Boosted trees that train at a time, rows of a training table for each of its partitions, and steps of the quantiles that bins are picked from.
SIDE = 8
ROWS = 50_000
STEPS = 1024


class Stump(Estimator, HasFeaturesCol, HasLabelCol, HasProbabilityCol):
    """The share of 1s among rows on either side of the mean of one feature: a baseline that costs two aggregates."""

    def __init__(self, feature: int = 0):
        super().__init__()
        self.feature = feature

    def _fit(self, df: DataFrame) -> StumpModel:
        x, y = F.get(vector_to_array(self.getFeaturesCol()), F.lit(self.feature)), F.col(self.getLabelCol())
        mean = df.agg(F.avg(x)).first()[0]
        low, high = df.agg(F.avg(F.when(x <= mean, y)), F.avg(F.when(x > mean, y))).first()
        out = StumpModel(self.feature, mean, low or 0.0, high or 0.0)
        return out._set(featuresCol=self.getFeaturesCol(), probabilityCol=self.getProbabilityCol())


class StumpModel(Model, HasFeaturesCol, HasProbabilityCol):
    def __init__(self, feature: int = 0, mean: float = 0.0, low: float = 0.0, high: float = 0.0):
        super().__init__()
        self.feature, self.mean, self.low, self.high = feature, mean, low, high

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.get(vector_to_array(self.getFeaturesCol()), F.lit(self.feature))
        p = F.when(x > self.mean, F.lit(self.high)).otherwise(F.lit(self.low))
        return df.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))


class Boosting(GBTClassifier):
    """Gradient-boosted trees; those of several label columns train side by side, since each is a series of short jobs."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Any) -> Iterator[tuple[int, Any]]:
        fits = [inheritable_thread_target(dataset.sparkSession)(lambda i=i, own=own: (i, self.fit(dataset, own))) for i, own in enumerate(paramMaps)]
        with ThreadPool(min(SIDE, len(fits))) as pool:
            return iter(pool.map(lambda f: f(), fits, chunksize=1))


def cuts(df: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Where the bins of numbers end: at each value but the largest where there are so few, else at quantiles that differ.

    Two aggregates. A value that many rows share takes one bin, and the other bins are dealt to the rest.
    """
    if not names:
        return {}
    x = {c: observed(df, c).cast("double") for c in names}
    # one literal, since an array of literals makes the plan of many columns slow
    steps = F.from_json(F.lit(json.dumps([i / STEPS for i in range(1, STEPS)])), "array<double>")
    sums = [f(v) for v in x.values() for f in (F.max, F.approx_count_distinct, lambda v: F.percentile_approx(v, steps, 10 * STEPS))]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    out, few = {}, []
    for i, c in enumerate(names):
        top, n, at = row[3 * i : 3 * i + 3]
        at = sorted({v for v in at if v < top})
        out[c] = at if len(at) < bins else [at[len(at) * j // bins] for j in range(1, bins)]
        few += [c] if n <= 2 * bins else []
    if few:
        for c, own in zip(few, df.agg(*[F.collect_set(x[c]).alias(f"s{i}") for i, c in enumerate(few)]).first()):
            out[c] = sorted(own)[:-1] if len(own) <= bins else out[c]
    return out


def binned(x: Column, at: list[float], first: int = 0) -> Column:
    """How many of the sorted numbers are below x, by halves."""
    if not at:
        return F.lit(first)
    mid = len(at) // 2
    return F.when(x <= at[mid], binned(x, at[:mid], first)).otherwise(binned(x, at[mid + 1 :], first + mid + 1))


class MissingnessClassifier:
    """P(missing) of each cell from the row's other columns, by gradient-boosted trees or any classifier of pyspark.ml with probabilities.

    A predictor is a number or a flag for each of its strings (hash buckets
    beyond 256), and whether it is missing; this plan is frozen by ``fit``. Dates
    and times are no predictors, and they count as never missing. The predictors
    of all columns are written once, as one array a row, and each classifier
    trains on its part of it. Trees tell a number by its bin alone, so they get the
    bins, and rows that are alike are one row with their count as its weight; where
    such rows are few, those that were in the fit are also scored once.
    A column that is always or never missing needs no classifier. ``key``:
    columns that are left out and address cells.
    """

    def __init__(self, classifier: Any = None, predictors: Any = "all", key: Iterable[str] = (), rounds: int = 100, seed: int = 0, depth: int = 6, step: float = 0.3):
        if classifier is not None and not (isinstance(classifier, Estimator) and all(classifier.hasParam(p) for p in ("featuresCol", "labelCol", "probabilityCol"))):
            raise TypeError(f"a classifier is an estimator with features, label and probability columns, not {type(classifier).__name__}")
        self.classifier, self.predictors, self.key, self.rounds, self.seed, self.depth, self.step = classifier, predictors, list(key), rounds, seed, depth, step

    def _estimator(self) -> Any:
        one = self.classifier
        if one is None:
            one = Boosting(maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=self.seed, weightCol="__weight")
        return one.copy({one.getParam(p): name for p, name in OWN.items() if one.hasParam(p)})

    def _cells(self, df: DataFrame) -> Column:
        """What the predictors' cells tell, as a struct: a number or its bin, a string or its hash bucket; null where it is missing."""
        out = {}
        for c in self.spans_:
            if c in self.cuts_:
                out[c] = F.when(~is_missing(df, c), binned(F.col(f"`{c}`").cast("double"), self.cuts_[c]))
            else:
                out[c] = regression.Design(self.terms_[c], {}).cells(df).get(c, observed(df, c))
        return F.struct(*[x.alias(c) for c, x in out.items()])

    def _all(self, cells: Column) -> Column:
        """The plan's columns as an array, predictor after predictor, each followed by its flag. A missing number counts as 0."""
        out = []
        for c in self.spans_:
            x, levels = cells.getField(c), [v for _, v in self.terms_[c]]
            if levels == [None]:
                out.append(F.array(F.coalesce(x.cast("double"), F.lit(float(sum(v < 0 for v in self.cuts_.get(c, [])))))))
            elif levels:
                out.append(regression.flags(levels, F.coalesce(x, F.lit(0 if isinstance(levels[0], int) else ""))))
            out.append(F.array(x.isNull().cast("double")))
        return F.concat(*out)

    def _table(self, df: DataFrame, todo: list[str]) -> DataFrame:
        """Cells, the array of all predictors, whether the cells of each column are missing, and a weight: of each row, or for boosted trees of rows that are alike."""
        rows = df.select(self._cells(df).alias("__cells"), F.struct(*[is_missing(df, c).cast("double").alias(c) for c in todo]).alias("gone"), F.lit(1).alias("n"))
        if self.classifier is None:
            rows = rows.groupBy("__cells", "gone").agg(F.count("n").alias("n"))
        return rows.select("__cells", "gone", self._all(F.col("__cells")).alias("__x"), F.col("n").cast("double").alias("__weight"))

    def _part(self, whole: Column, c: str) -> Column:
        """The elements of the array of all predictors that belong to those of a column."""
        return F.concat(*[F.slice(whole, self.spans_[x][0] + 1, self.spans_[x][1]) for x in self.names_[c]])

    def fit(self, df: DataFrame) -> MissingnessClassifier:
        counts = missing_counts(check_frame(df))
        gone = [c for c in df.columns if counts[c] == counts[""] and c not in self.key]
        if gone:
            raise ValueError(f"all values missing in {gone}")
        self.columns_ = [c for c in df.columns if c not in self.key]
        self.names_ = {c: regression.usable(df, names) for c, names in predictors(self.predictors, self.columns_).items()}
        self.models_, self.constant_, self.terms_, self.spans_, self.cuts_, self.known_ = {}, {}, {}, {}, {}, None
        start = 0
        for c in dict.fromkeys(x for names in self.names_.values() for x in names):
            self.terms_[c] = regression.design(df, [c], fill=False).terms
            self.spans_[c] = (start, len(self.terms_[c]) + 1)
            start += len(self.terms_[c]) + 1
        todo = [c for c in self.columns_ if counts[c] and self.names_[c]]
        self.constant_ = {c: counts[c] / max(1, counts[""]) if counts[c] else 0.0 for c in self.columns_ if c not in todo}
        if not todo:
            return self
        one = self._estimator()
        if self.classifier is None:
            self.cuts_ = cuts(df, [c for c in self.spans_ if is_numeric(df, c)], one.getMaxBins())
        table, path = written(self._table(df, todo), "cells")
        if self.classifier is None:
            n = table.count()
            table = table.coalesce(1 + n // ROWS)
        self.own_ = {c: {p: f"{OWN[p]}{i}" for p in ("labelCol", "featuresCol")} for i, c in enumerate(todo)}
        train = table.select("__weight", *[F.col(f"gone.`{c}`").alias(own["labelCol"]) for c, own in self.own_.items()], *[array_to_vector(self._part(F.col("__x"), c)).alias(own["featuresCol"]) for c, own in self.own_.items()])
        models = one.fit(train, [{one.getParam(p): name for p, name in own.items()} for own in self.own_.values()])
        self.models_ = dict(zip(todo, models))
        if self.classifier is None and n <= ROWS:
            known = self._chances(table.select("__cells", "__x").dropDuplicates(["__cells"]))
            self.known_ = written(known.select("__cells", F.struct(*[F.col(f"`{c}_pred`").alias(c) for c in todo]).alias("__known")), "known")[0]
        removed(df.sparkSession, path)
        return self

    def _checked(self, df: DataFrame) -> None:
        if not hasattr(self, "models_"):
            raise ValueError("fit comes first")
        own = [c for c in check_frame(df).columns if c not in self.key]
        if set(own) != set(self.columns_):
            raise ValueError(f"fit and predict need the same columns: {sorted(set(own) ^ set(self.columns_))}")

    def _chances(self, df: DataFrame) -> DataFrame:
        """df, which has the array __x, with <column>_pred by the column's model."""
        for c, model in self.models_.items():
            own = self.own_[c]
            scored = model.transform(df.withColumn(own["featuresCol"], array_to_vector(self._part(F.col("__x"), c))))
            p = vector_to_array(OWN["probabilityCol"])[1]
            # trees are walked only where no row like this one was when they were fitted
            p = F.coalesce(F.col("__known").getField(c), p) if "__known" in df.columns else p
            df = scored.withColumn(f"{c}_pred", p).drop(*OWN.values(), *own.values())
        return df

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with <column>_pred, the chance that the cell is missing."""
        self._checked(df)
        out = df
        if self.models_:
            out = df.withColumn("__cells", self._cells(df))
            out = out if self.known_ is None else out.join(F.broadcast(self.known_), "__cells", "left")
            out = self._chances(out.withColumn("__x", self._all(F.col("__cells"))))
        out = out.withColumns({f"{c}_pred": F.lit(p) for c, p in self.constant_.items()})
        return out.select(*[f"`{c}`" for c in df.columns], *[f"`{c}_pred`" for c in self.columns_])

    def predict(self, df: DataFrame) -> DataFrame:
        """df with <column>_pred, 1 where the cell is likelier missing than not."""
        out = self.predict_proba(df)
        return out.withColumns({f"{c}_pred": (F.col(f"{c}_pred") > 0.5).cast("int") for c in self.columns_})

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def fit_predict_proba(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict_proba(df)

    def _scored(self, df: DataFrame, use_exist: bool) -> DataFrame:
        """df and its chances, written, so that each row is scored once."""
        if not use_exist:
            self.fit(df)
        self._checked(df)
        return written(self.predict_proba(df), "scored")[0]

    def _wrong(self, scored: DataFrame, thresh: float) -> dict[str, Column]:
        return {c: ~is_missing(scored, c) & (F.col(f"{c}_pred") > thresh) for c in self.columns_}

    def gen_test_indices(self, df: DataFrame, thresh: float = 0.5, use_exist: bool = False) -> DataFrame:
        """The observed cells that are likely to be missing: (column, key), also as ``test_indices``.

        Fits first, unless ``use_exist`` takes the fit there is.
        """
        scored = self._scored(df, use_exist)
        self.test_indices = cells.addresses(scored, self._wrong(scored, thresh), self.key)
        return self.test_indices

    def gen_test_df(self, df: DataFrame, thresh: float = 0.5, m: float = 0.05, use_exist: bool = False) -> DataFrame:
        """df with these cells nulled; a warning for each column of which at most the share ``m`` is."""
        scored = self._scored(df, use_exist)
        wrong = self._wrong(scored, thresh)
        row = scored.agg(F.count(F.lit(1)), *[F.count_if(w) for w in wrong.values()]).first()
        for c, n in zip(wrong, row[1:]):
            if n <= int(m * row[0]):
                warnings.warn(f"{n} cells of {c} set to missing, {100 * m:g} % or fewer", stacklevel=2)
        return scored.select(*[F.when(~wrong[c], F.col(f"`{c}`")).alias(c) if c in wrong else F.col(f"`{c}`") for c in df.columns])
