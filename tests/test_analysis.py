import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import plots, regression, temporal
from lacuna.operators.imputers import MultipleImputer, SingleImputer
from lacuna.operators.pooling import MiLinearRegression, MiLogisticRegression


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, np.linalg.inv(h)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(50, 9, 400), rng.normal(0, 1, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(a - 50) / 9 - b))).tolist()
    rows = [(i, float(a[i]), float(b[i]) if i % 7 else None, "yes" if y[i] else "no") for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, y string")


def test_logistic_agrees_with_newton(spark, table):
    """Both imputations are the same, so the pooled fit is that of the filled table."""
    mi = MultipleImputer(n=2, strategy={"b": "mean"}, key=["id"])
    model = MiLogisticRegression(mi).fit(table, "y", ["a", "b"])
    d = table.toPandas()
    x = np.column_stack([np.ones(400), d.a, d.b.fillna(d.b.mean())])
    beta, cov = newton(x, (d.y == "yes").to_numpy(float))
    assert np.allclose(model.statistics_["coefs"], beta, rtol=1e-6) and np.allclose(model.statistics_["vw"], np.diag(cov), rtol=1e-6)
    assert np.allclose(model.statistics_["vb"], 0) and [r.term for r in model.summary(spark).collect()] == ["const", "a", "b"]
    whole = table.na.fill({"b": 0.0})
    got = model.predict(model.predict_proba(whole), 0.7).collect()
    z = np.column_stack([np.ones(400), d.a, d.b.fillna(0)]) @ beta
    want = {i: 1 / (1 + np.exp(-v)) for i, v in zip(d.id, z)}
    assert all(abs(r.probability - want[r.id]) < 1e-6 and (r.prediction == "yes") == (r.probability >= 0.7) for r in got)


def test_prediction_needs_whole_predictors(table):
    model = MiLinearRegression(MultipleImputer(n=2, strategy={"b": "mean"}, key=["id"]))
    with pytest.raises(ValueError, match="fit comes first"):
        model.predict(table)
    model.fit(table, "a", ["b"])
    with pytest.raises(ValueError, match="missing cells"):
        model.predict(table)
    with pytest.raises(ValueError, match="absent"):
        model.predict(table.drop("b"))
    assert model.predict(table.na.drop()).where("prediction IS NULL").isEmpty()


def test_bayesian_logistic(table):
    d = table.withColumn("y", F.when(F.col("id") % 5 > 0, F.col("y")))
    got = regression.fill(d, "y", "bayesian binary logistic", ["a"], ["id"])
    new = got.where("id % 5 = 0").toPandas()
    # one predictor: the larger value from some a on
    assert set(new.y) == {"no", "yes"} and new.a[new.y == "no"].max() < new.a[new.y == "yes"].min()
    assert got.where("id % 5 > 0").exceptAll(d.where("id % 5 > 0")).isEmpty()
    assert regression.fill(d, "y", "bayesian binary logistic", ["a"], ["id"], thresh=1.0).where("id % 5 = 0 AND y = 'yes'").isEmpty()
    drawn = [sorted(map(tuple, regression.fill(d, "y", "bayesian binary logistic", ["a"], ["id"], seed=s, fill_value="random").collect()), key=str) for s in (1, 1)]
    assert drawn[0] == drawn[1]
    with pytest.raises(ValueError, match="categories"):
        regression.fill(d.withColumn("y", F.col("id").cast("string")), "y", "bayesian binary logistic", ["a"], ["id"])


def test_separated_classes_end(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("a"), F.when(F.col("id") % 9 > 0, (F.col("id") > 20).cast("string")).alias("y"))
    got = regression.fill(df, "y", "bayesian binary logistic", ["a"], ["id"]).where("id % 9 = 0").collect()
    assert all(r.y == str(r.id > 20).lower() for r in got)


def test_default_time_draws_tied_strings(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 100, F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("s"))
    got = [r.s for r in temporal.fill(df, "s", "default time", ["id"]).where("id >= 100").collect()]
    assert len(got) == 100 and 20 < got.count("a") < 80 and set(got) == {"a", "b"}


def test_plot_tables(spark):
    rows = [(1, 1.0, None, "p"), (2, None, None, "q"), (3, 3.0, 3.0, None), (4, 4.0, 4.0, "p"), (5, None, 5.0, "p")]
    df = spark.createDataFrame(rows, "id long, u double, v double, s string")
    single = SingleImputer({"u": "mean"}, key=["id"])
    assert sorted((r.x, r.imputed) for r in plots.scatter(df, single, "u", "id", "u").collect()) == [(1.0, False), (8 / 3, True), (8 / 3, True), (3.0, False), (4.0, False)]
    with pytest.raises(ValueError, match="absent"):
        plots.scatter(df, single, "u", "none")
    with pytest.raises(ValueError, match="color"):
        plots.scatter(df, single, "u", "v", "s")
    merges = plots.dendrogram(df.select("u", "v", "s"))
    assert [len(a | b) for a, b, _ in merges] == [2, 3] and merges[0][2] == pytest.approx(2**0.5)
    with pytest.raises(ValueError, match="no cell"):
        plots.dendrogram(df.select("id"))
    with pytest.raises(ValueError, match="no cell"):
        plots.correlation(df.select("id"))
    mi = MultipleImputer(n=2, strategy={"u": "mean"}, key=["id"])
    boxes = {r.imp_num: (r["count"], r.min, r["median"], r.max) for r in plots.boxplots(df, mi, "u").collect()}
    assert boxes == {0: (3, 1.0, 3.0, 4.0), 1: (5, 1.0, 8 / 3, 4.0), 2: (5, 1.0, 8 / 3, 4.0)}
    bins = sorted((r.imp_num, r.bin, r["count"]) for r in plots.histogram(df, mi, "u", 3).collect())
    assert bins == [(0, 0, 1), (0, 2, 2), (1, 0, 1), (1, 1, 2), (1, 2, 2), (2, 0, 1), (2, 1, 2), (2, 2, 2)]
    with pytest.raises(TypeError):
        plots.histogram(df, mi, "s")
