"""Boosted trees of the missingness classifier: trained on rows that differ, with counts, and scored once for rows that are alike."""

import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lacuna.operators import classifier
from lacuna.operators.classifier import MissingnessClassifier


def frame(spark, n=3000, values=12):
    """Numbers of few values, or of as many as there are rows, and strings, missing by rules of one another."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000))
    v = (F.pmod(F.xxhash64("id", F.lit("v")), F.lit(values)) + 1).cast("double") * 1.5
    s = F.element_at(F.array(*map(F.lit, ("", "a", "b b", "ü"))), (h("s") % 4 + 1).cast("int"))
    df = spark.range(n).select("id", v.alias("v"), s.alias("s"), (h("b") < 300).alias("b.c"), F.timestamp_seconds("id").alias("at"))
    gone_v = F.when(F.col("s") == "a", h("x") < 600).otherwise(h("x") < 100)
    gone_s = F.when(F.col("v") > values * 0.75, h("y") < 700).otherwise(h("y") < 50)
    return df.select("id", F.when(gone_v, float("nan")).otherwise(F.col("v")).alias("v"), F.when(~gone_s, F.col("s")).alias("s"), "`b.c`", F.when(h("z") > 100, F.col("at")).alias("at"))


def chances(df, *names):
    return {r.id: tuple(r[f"{c}_pred"] for c in names) for r in df.collect()}


def near(a, b, tol=1e-6):
    return a.keys() == b.keys() and all(abs(x - y) < tol for i in a for x, y in zip(a[i], b[i]))


def test_rows_alike_are_one_row(spark, monkeypatch):
    """The trees' table has a row for each kind of row, weighed by its count, in one partition, and all columns train from it at a time."""
    asked, side, fit = [], threading.Barrier(2, timeout=60), GBTClassifier.fit

    def spied(self, df, params=None):
        if isinstance(params, dict):
            side.wait()
        else:
            asked.append((df.count(), df.agg(F.sum(self.getWeightCol())).first()[0], df.rdd.getNumPartitions()))
        return fit(self, df, params)

    monkeypatch.setattr(GBTClassifier, "fit", spied)
    for values in (12, 10**9):
        df = frame(spark, 20_000, values).drop("at")
        guess = MissingnessClassifier(key=["id"], rounds=2, depth=2).fit(df)
        (n, total, parts), asked[:] = asked[0], []
        assert total == 20_000 and n <= 33 * 5 * 2 and parts == 1
        assert len(guess.cuts_["v"]) == (11 if values == 12 else 31) and guess.known_.count() <= n


def test_as_trees_on_every_row(spark):
    """Numbers of few values: the same chances as MLlib's trees over the rows and the numbers themselves. at is missing by no rule and is no predictor."""
    df = frame(spark)
    want = MissingnessClassifier(GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3), key=["id"]).fit(df).predict_proba(df)
    got = MissingnessClassifier(key=["id"], rounds=4, depth=3).fit(df).predict_proba(df)
    assert got.columns == want.columns == ["id", "v", "s", "b.c", "at", *(f"{c}_pred" for c in ("v", "s", "b.c", "at"))]
    got, want = (chances(x, "v", "s", "b.c", "at") for x in (got, want))
    assert near(got, want) and len({x[0] for x in got.values()}) > 3 and {x[2] for x in got.values()} == {0.0}


def test_as_trees_on_every_bin(spark):
    """Numbers that all differ: the same chances as trees over each row's bins."""
    df = frame(spark, values=10**9).drop("at")
    guess = MissingnessClassifier(key=["id"], rounds=4, depth=3).fit(df)
    rows = df.select("id", F.col("v").isNull().alias("_"), F.isnan("v").cast("double").alias("y"), F.lit(1).alias("one"), array_to_vector(guess._part(guess._all(guess._cells(df)), "v")).alias("x"))
    plain = GBTClassifier(featuresCol="x", labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3).fit(rows).transform(rows).select("id", vector_to_array("probability")[1].alias("v_pred"))
    assert near(chances(guess.predict_proba(df), "v"), chances(plain, "v"))
    # equally full bins
    n = [r["count"] for r in df.where("NOT isnan(v)").groupBy(guess._cells(df)["v"]).count().collect()]
    assert len(n) == 32 and max(n) < 1.2 * min(n)


def test_rows_that_no_fit_has_seen(spark):
    """Unseen kinds of rows get their chances from the models; rows keep their number, also where df is cut at random."""
    df = frame(spark)
    guess = MissingnessClassifier(key=["id"], rounds=3, depth=3).fit(df.where("s <> 'ü' AND v > 3"))
    cells = df.select(guess._cells(df).alias("__cells"))
    unseen = cells.join(guess.known_, "__cells", "left_anti")
    # a cell that is missing is as good a key as any
    assert not unseen.isEmpty() and unseen.where("__cells.v IS NULL AND __cells.s IN ('', 'a', 'b b')").isEmpty()
    got = guess.predict_proba(df)
    got, guess.known_ = chances(got, "v", "s"), None
    assert near(got, chances(guess.predict_proba(df), "v", "s"), 1e-12) and len(got) == 3000
    many = guess.predict_proba(df.sample(0.5))
    assert many.where("v_pred IS NULL OR s_pred IS NULL").isEmpty()


def test_many_kinds_of_rows(spark, monkeypatch):
    """More kinds than fit into a partition: no table of known rows, and the same chances."""
    df = frame(spark)
    few = MissingnessClassifier(key=["id"], rounds=3, depth=3).fit(df)
    monkeypatch.setattr(classifier, "ROWS", 20)
    many = MissingnessClassifier(key=["id"], rounds=3, depth=3).fit(df)
    assert many.known_ is None and few.known_ is not None
    assert near(chances(few.predict_proba(df), "v", "s"), chances(many.predict_proba(df), "v", "s"))


@pytest.mark.parametrize("values,want", [([1.0] * 5, []), ([True, False], [0.0]), ([3, 1, 2, 2], [1.0, 2.0]), ([float("inf"), float("-inf"), 0.0, float("nan"), None], [float("-inf"), 0.0]), ([*range(32)], [float(i) for i in range(31)])])
def test_few_values_are_bins(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], f"`a.b` {'boolean' if True in values and False in values and len(values) == 2 else 'double' if isinstance(values[0], float) else 'int'}")
    assert classifier.cuts(df, ["a.b"], 32) == {"a.b": want}
    got = [r[0] for r in df.where("`a.b` IS NOT NULL").select(classifier.binned(F.col("`a.b`").cast("double"), want)).collect()]
    assert got == [sum(t < v for t in want) if v == v else len(want) for v in values if v is not None]


def test_rare_and_common_values(spark):
    """One value in 100,000 takes a bin where values are few; one that most rows share takes one bin, not all."""
    df = spark.range(100_000).select(F.when(F.col("id") == 7, -5).otherwise(F.col("id") % 3).alias("few"), F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id") * 1.0).alias("most"))
    got = classifier.cuts(df, ["few", "most"], 32)
    assert got["few"] == [-5.0, 0.0, 1.0] and len(got["most"]) == 31 and got["most"][0] < 4000
    gaps = [b - a for a, b in zip(got["most"], got["most"][1:])]
    assert max(gaps) < 2 * min(gaps)
