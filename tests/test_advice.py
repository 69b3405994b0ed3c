import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import pooling, regression, temporal, univariate
from lacuna.operators.imputers import SingleImputer
from lacuna.plans.catalog import QUERIES


def test_spline_memory_is_linear():
    rng = np.random.default_rng(1)
    at = np.arange(4000.0)
    ok = rng.random(4000) > 0.2
    ok[[0, -1]] = True
    tracemalloc.start()
    got = temporal._curve(at[ok], np.sin(at[ok] / 40), at[~ok], "cubic", None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got - np.sin(at[~ok] / 40)).max() < 1e-3
    assert peak < 30e6


@pytest.mark.parametrize("name,kw", [("locf", {}), ("locf", {"start": "mean"}), ("nocb", {}), ("nocb", {"end": 3.0}), *[("interpolate", {"method": m, **k}) for m, k in (("linear", {}), ("time", {}), ("cubic", {}), ("quadratic", {"start": "mean"}), ("spline", {"degree": 3}), ("barycentric", {}))]])
def test_series_are_cut(spark, monkeypatch, name, kw):
    """A hot series, one with a long gap, small ones, one without values and one of the null user: as in a single range."""
    t = F.timestamp_seconds(F.col("id") * 7 % 900 + F.col("id") % 3)
    u = F.when(F.col("id") % 900 < 600, 1).when(F.col("id") % 900 < 800, 2).when(F.col("id") % 900 < 830, 3).when(F.col("id") % 900 < 870, None).otherwise(F.col("id"))
    gone = (F.xxhash64("id") % 3 == 0) | ((u == 2) & F.col("id").between(620, 790)) | (u == 3)
    n = 900 if kw.get("method") != "barycentric" else 40
    df = spark.range(n).select("id", u.alias("u"), t.alias("t"), F.when(~F.coalesce(gone, F.lit(False)), F.sin(F.col("id") / 9)).alias("v"))
    run = lambda: {r.id: r.v for r in getattr(temporal, name)(df, "v", ["t", "id"], ["u"], **kw).collect()}
    monkeypatch.setattr(temporal, "LEAST", 10**9)
    whole = run()
    monkeypatch.setattr(temporal, "LEAST", 6)
    monkeypatch.setattr(temporal, "RANGES", 30)
    assert n < 900 or temporal._cut(df, ["u"], ["t", "id"]).where("u = 1").select("__range").distinct().count() > 20
    cut = run()
    assert len(cut) == n and cut.keys() == whole.keys()
    for i, v in whole.items():
        assert (v is None) == (cut[i] is None) and (v is None or abs(v - cut[i]) < 1e-9), (i, v, cut[i])


def _drawn(df, strategy, kwargs=None, column="v"):
    return univariate.fill(df, univariate.fit(df, {column: strategy}, kwargs), df, 1, ["id"])


def test_random_draws_are_not_rounded(spark):
    """3,000,000 distinct values: more than 2^20 of them can be drawn, and each draw finds a value."""
    df = spark.range(6_000_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = _drawn(df, "random").where("id % 2 = 1").agg(F.count(F.lit(1)), F.count("v"), F.countDistinct("v")).first()
    assert got[:2] == (3_000_000, 3_000_000)
    assert abs(got[2] - 3_000_000 * (1 - np.exp(-1))) < 10_000


def test_rare_categories_are_drawn(spark):
    """200 values of one row beside one of 4,000,000: shares below 2^-20."""
    df = spark.range(8_000_200).select("id", F.when(F.col("id") < 200, F.concat(F.lit("r"), "id")).when(F.col("id") % 2 == 0, "x").alias("v"))
    got = {r[0]: r[1] for r in _drawn(df, "categorical").where("id >= 200 AND id % 2 = 1").groupBy("v").count().collect()}
    assert sum(got.values()) == 4_000_000 and None not in got
    rare = [n for v, n in got.items() if v != "x"]
    assert 140 < sum(rare) < 260 and 100 < len(rare) < 155


def test_tied_modes_are_all_drawn(spark):
    df = spark.range(120_000).select("id", F.when(F.col("id") < 40_000, F.concat(F.lit("s"), (F.col("id") % 20_000).cast("string"))).alias("v"))
    for strategy, kwargs in (("mode", {"v": {"fill_strategy": "random"}}), ("default univariate", None)):
        got = _drawn(df, strategy, kwargs).where("id >= 40000").agg(F.count("v"), F.countDistinct("v")).first()
        assert got[0] == 80_000 and abs(got[1] - 20_000 * (1 - np.exp(-4))) < 200
    assert _drawn(df, "mode").where("id >= 40000").select("v").distinct().count() == 1


def test_pooled_columns(spark):
    """By hand for m = 2, vw = 1.5, vb = 2, dfcom = 10; and the columns of the registered summary."""
    r = pooling.rubin(np.array([[1.0], [3.0]]), np.array([[1.0], [2.0]]), 10)
    lam = 3 / 4.5
    old, seen = 1 / lam**2, 11 / 13 * 10 * (1 - lam)
    df = old * seen / (old + seen)
    fmi = (df + 1) / (df + 3) * lam + 2 / (df + 3)
    for k, v in {"dfcom": 10, "dfadj": df, "lambda_": lam, "riv": 2, "fmi": fmi, "eff": 1 / (1 + fmi / 2)}.items():
        assert np.isclose(r[k][0], v), k
    assert QUERIES["pooled_regression"](spark, "/root/testdata/sf0.001").columns == "term coefs std vw vb vt dfcom dfadj lambda riv fmi eff".split()
    assert pooling.raw_bias([2.0, 3.0], [1.0, 4.0]).tolist() == [1, -1] and pooling.percent_bias(3, -4).tolist() == [-175]
    with pytest.raises(ValueError):
        pooling.raw_bias([1.0, 2.0], [1.0])


def test_registered_classifier(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    asked = []
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *_: asked.append((self.getMaxIter(), self.getMaxDepth(), self.getStepSize())) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        QUERIES["missingness_classifier"](spark, "/root/testdata/sf0.001")
    assert asked == [(100, 6, 0.3)]


def test_nearest_donors_across_thin_ranges(spark):
    """Ranges of one or two donors: each of the five nearest is drawn from, and no other."""
    df = spark.range(3000).select("id", (F.col("id") % 60 * F.lit(1.0)).alias("x"), F.when((F.col("id") < 60) & (F.col("id") % 60 != 30), F.col("id") * 2.0).alias("y"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        model = regression.least_squares(df, "y", ["x"])
        rows = regression.donors(df, "y", model, model.beta, ["id"], 1).where("id >= 60 AND x BETWEEN 10 AND 20").groupBy("x").agg(F.collect_set("y").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {r.x: sorted(r.s) for r in rows} == {float(x): [2.0 * (x + d) for d in range(-2, 3)] for x in range(10, 21)} and sum(r.n for r in rows) == 49 * 11


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("s"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("x"))
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for s, x in (("categorical", "norm"), ("random", "random")):
                done = SingleImputer({"s": s, "x": x}, key=["id"], seed=5).fit_transform(df.repartition(int(parts)))
                # the fitted mean's last bit depends on the order of its sum
                got.append(sorted((r.id, r.s, round(r.x, 6)) for r in done.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5] and got[0] != got[1]
