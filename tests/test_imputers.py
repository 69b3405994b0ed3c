"""Imputers as ML estimators: written and loaded models, strategies and classifiers of one's own, cell addresses, priors, chained rounds."""

import warnings

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lacuna.operators import cells, posterior, regression
from lacuna.operators.classifier import MissingnessClassifier, Stump
from lacuna.operators.imputers import MiceImputer, MiceImputerModel, MultipleImputer, MultipleImputerModel, SingleImputer, SingleImputerModel
from lacuna.operators.pooling import MiLinearRegression, MiLogisticRegression
from lacuna.operators.strategies import REGISTRY, Strategy, register


class Largest(Strategy):
    """The largest observed value."""

    name = "largest"

    def fit(self, df, ask):
        return {"top": df.agg(F.max(ask.column)).first()[0]}, {"seen": df.where(F.col(ask.column).isNotNull()).select(ask.column)}

    def fill(self, df, ask, params, tables):
        assert ask.column in tables["seen"].columns
        return df.withColumn(ask.column, F.coalesce(ask.column, F.lit(params["top"])))


class Neighbour(Strategy):
    """The other column's value and what an argument adds, refitted in chained rounds."""

    name, predictive = "neighbour", True

    def fit(self, df, ask):
        return {"from": ask.predictors[0], "plus": ask.kwargs.get("plus", 0.0)}, {}

    def fill(self, df, ask, params, tables):
        return df.withColumn(ask.column, F.coalesce(ask.column, F.col(params["from"]) + params["plus"]))


def frame(spark, n=400, gap=4):
    t = F.to_date(F.lit("2024-01-01"))
    x = F.col("id") % 23 * 1.5
    gone = lambda i: F.xxhash64("id", F.lit(i)) % gap == 0
    return spark.range(n).select(
        "id", (F.col("id") * 7 % n).alias("at"), t.alias("day"), x.alias("x"),
        F.when(~gone(1), 3 * x + F.sin("id")).alias("y"), F.when(~gone(2), x - F.cos("id")).alias("z"),
        F.when(~gone(3), F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("s"), F.when(~gone(4), F.when(F.col("x") > 16, "hi").otherwise("lo")).alias("b"),
    )


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


SPECS = {
    "mean": ({"y": "mean"}, {}), "median": ({"y": "median"}, {}), "mode": ({"s": "mode", "b": "mode", "z": "mode"}, {"b": {"fill_strategy": "random"}}), "random": ({"s": "random", "y": "random"}, {}), "norm": ({"y": "norm", "z": "normal unit variance"}, {}), "categorical": ({"s": "categorical"}, {}),
    "time": ({"y": "locf", "z": "interpolate"}, {"z": {"method": "cubic"}}), "least": ({"y": "least squares", "z": "stochastic"}, {}), "bayes": ({"y": "bayesian least squares", "z": "bayesian least squares"}, {"y": {"asd": 5.0, "bsd": 2.0, "sample": 50, "tune": 20}, "z": {"fill_value": "random", "sig": 2.0, "sample": 60, "tune": 20, "predictive": True}}),
    "pmm": ({"y": "pmm", "z": "lrd"}, {"y": {"am": 1.0, "bsd": 3.0, "sample": 50, "tune": 10}, "z": {"residual": "classic", "neighbors": 3}}), "logistic": ({"b": "binary logistic", "s": "multinomial logistic"}, {}), "bayes logistic": ({"b": "bayesian binary logistic"}, {"b": {"fill_value": "random"}}), "defaults": ("default predictive", {}), "own": ({"y": Largest(), "z": Neighbour()}, {"z": {"plus": 0.5}}),
}


@pytest.mark.parametrize("name", list(SPECS))
def test_models_are_written_and_loaded(spark, tmp_path, name):
    strategy, kwargs = SPECS[name]
    df, other = frame(spark), frame(spark, 90, 3)
    model = SingleImputer(strategy, imp_kwgs=kwargs, key=["id"], order=["at"], seed=3).fit(df)
    assert isinstance(model, SingleImputerModel)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = SingleImputerModel.load(str(tmp_path / "m"))
    assert again.statistics_ == model.statistics_ and again.uid == model.uid and again.getOrDefault("seed") == 3
    for d in (df, other):
        got = model.transform(d)
        assert got.columns == d.columns and rows(got) == rows(again.transform(d))
        done = got.select(*model.statistics_)
        assert done.where(" OR ".join(f"{c} IS NULL" for c in done.columns)).isEmpty()
        # observed cells stay
        seen = d.alias("a").join(got.alias("b"), "id").where(" OR ".join(f"(a.{c} IS NOT NULL AND NOT a.{c} <=> b.{c})" for c in model.statistics_))
        assert seen.isEmpty() and got.count() == d.count()


def test_pipeline_with_an_imputer(spark, tmp_path):
    df = frame(spark)
    stages = [SingleImputer({"y": "pmm", "z": "mean"}, predictors={"y": ["x"]}, key=["id"], seed=1), VectorAssembler(inputCols=["x", "y", "z"], outputCol="v")]
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "p"))
    fitted = Pipeline.load(str(tmp_path / "p")).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    a, b = (m.transform(df).drop("v") for m in (fitted, PipelineModel.load(str(tmp_path / "m"))))
    assert rows(a) == rows(b) and a.where("y IS NULL OR z IS NULL").isEmpty()
    # params given to fit override
    one = SingleImputer({"y": "stochastic"}, key=["id"], seed=1)
    assert rows(one.fit(df, {one.seed: 9}).transform(df)) == rows(SingleImputer({"y": "stochastic"}, key=["id"], seed=9).fit_transform(df)) != rows(one.fit_transform(df))


@pytest.mark.parametrize("cls,model,extra", [(MultipleImputer, MultipleImputerModel, {}), (MiceImputer, MiceImputerModel, {"k": 2}), (MiceImputer, MiceImputerModel, {"k": 2, "chained": True})])
def test_several_imputations_are_written_and_loaded(spark, tmp_path, cls, model, extra):
    df = frame(spark, 200)
    spec = {"y": "stochastic", "z": "pmm", "s": "categorical", "b": "binary logistic"}
    fitted = cls(n=2, strategy=spec, key=["id"], seed=2, **extra).fit(df)
    fitted.save(str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    got = fitted.transform(df)
    # rounds are fitted anew, and the last digits of sums depend on their order
    assert rows(got, 5) == rows(again.transform(df), 5) and got.count() == 400
    assert got.where("y IS NULL OR z IS NULL OR s IS NULL OR b IS NULL").isEmpty()
    assert {i: rows(d, 5) for i, d in again.datasets(df)} == {i: rows(got.where(F.col("imp_num") == i).drop("imp_num"), 5) for i in (1, 2)}
    kept = got.join(df.select("id", *[F.col(c).alias(f"{c}0") for c in spec]), "id").where(" OR ".join(f"({c}0 IS NOT NULL AND {c}0 <> {c})" for c in spec))
    assert kept.isEmpty()


def test_one_fit_serves_all_seeds(spark, monkeypatch):
    df = frame(spark)
    spec = {"y": "bayesian least squares", "z": "normal unit variance", "s": "random", "b": "bayesian binary logistic"}
    kw = {"y": {"fill_value": "random", "asd": 3.0, "sample": 40, "tune": 10}, "b": {"fill_value": "random"}}
    fits = []
    was = regression.many_fits
    monkeypatch.setattr(regression, "many_fits", lambda *a, **k: fits.append(1) or was(*a, **k))
    several = MultipleImputer(n=3, strategy=spec, imp_kwgs=kw, key=["id"], seed=5, return_list=True).fit(df)
    assert len(fits) == 1 and isinstance(several.each(df), list) and isinstance(several.datasets(df), list)
    for i, one in enumerate(several.each(df)):
        assert rows(one) == rows(SingleImputer(spec, imp_kwgs=kw, key=["id"], seed=6 + 13 * i).fit_transform(df))


def test_predictors_of_each_imputation(spark):
    df = frame(spark)
    several = MultipleImputer(n=2, strategy={"y": "least squares"}, predictors=[{"y": ["x"]}, {"y": ["z"]}], key=["id"]).fit(df)
    for spec, got in zip(("x", "z"), several.each(df)):
        assert rows(got) == rows(SingleImputer({"y": "least squares"}, predictors={"y": [spec]}, key=["id"]).fit_transform(df))
    with pytest.raises(TypeError):
        MultipleImputer(n=2.0)
    with pytest.raises(ValueError):
        MiceImputer(k=0)


def test_strategies_of_ones_own(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 5.0, "b")], "id long, v double, s string")
    assert [r.v for r in SingleImputer({"v": Largest}, key=["id"]).fit_transform(df).orderBy("id").collect()] == [1.0, 5.0, 5.0]
    # the defaults take others by type, with their own arguments
    spec = {"default predictive": {"num_strategy": Largest(), "cat_strategy": "mode", "cat_kwgs": {"fill_strategy": "last"}}}
    model = SingleImputer("default predictive", imp_kwgs=spec, key=["id"]).fit(df)
    assert model.statistics_ == {"v": "largest", "s": "mode"} and model.transform(df).where("id = 2").first()[1:] == (5.0, "b")
    model.save(str(tmp_path / "m"))
    held = REGISTRY.pop("largest")
    try:
        with pytest.raises(ValueError, match="register"):
            SingleImputerModel.load(str(tmp_path / "m"))
    finally:
        register(held)
    assert rows(SingleImputerModel.load(str(tmp_path / "m")).transform(df)) == rows(model.transform(df))
    for bad in (object(), int, 3):
        with pytest.raises(TypeError):
            SingleImputer({"v": bad})
    with pytest.raises(TypeError):
        register(type("Nothing", (Strategy,), {"name": "nothing"}))
    with pytest.raises(ValueError):
        register(type("Mean", (Largest,), {"name": "mean"}))
    with pytest.raises(ValueError):
        SingleImputer("default time", imp_kwgs={"default time": {"num_strategy": "none such"}}, key=["id"]).fit(df)
    with pytest.raises(TypeError, match="unknown arguments"):
        SingleImputer({"v": "pmm"}, imp_kwgs={"pmm": {"neighbours": 3}}, key=["id"]).fit(df)


def test_own_strategy_in_chained_rounds(spark):
    df = frame(spark, 120)
    for chained in (False, True):
        got = MiceImputer(k=3, n=2, strategy={"z": Neighbour(), "y": "least squares"}, predictors={"z": ["x"], "y": ["z"]}, key=["id"], chained=chained).fit_transform(df)
        assert got.count() == 240 and got.where("y IS NULL OR z IS NULL").isEmpty()
        assert got.join(df.select("id", F.col("z").alias("z0")), "id").where("z0 IS NULL AND z <> x").isEmpty()


def test_addresses_of_cells(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, float("nan"), None), (None, 3.0, None), (None, 4.0, "b")], "id long, v double, s string")
    model = SingleImputer({"v": "mean", "s": "mode"}, key=["id"]).fit(df)
    found = model.imputed_(df)
    assert sorted(map(tuple, found.collect()), key=str) == [("s", 2), ("s", None), ("v", 1), ("v", 2)]
    other = spark.createDataFrame([(7, None, "a")], "id long, v double, s string")
    assert [tuple(r) for r in model.imputed_(other).collect()] == [("v", 7)]
    # nulled again, the filled table is the one that was given
    back = cells.blanked(model.transform(df), found, ["id"]).where("id IS NOT NULL")
    assert rows(back) == [(1, None, "a"), (2, None, None)]
    with pytest.raises(ValueError, match="key"):
        SingleImputer({"v": "mean"}).fit(df).imputed_(df)
    with pytest.raises(ValueError, match="named column"):
        cells.missing_cells(df.withColumnRenamed("id", "column"), ["v"], ["column"])
    assert cells.addresses(df, {}, ["id"]).count() == 0


def test_classifier_of_ones_own(spark):
    df = frame(spark, 300).drop("day").withColumn("y", F.when(F.col("x") < 20, F.col("y")))
    guess = MissingnessClassifier(DecisionTreeClassifier(maxDepth=3), key=["id", "at"])
    found = guess.gen_test_indices(df, thresh=0.3)
    assert found.columns == ["column", "id", "at"]
    p = {r.id: r for r in guess.predict_proba(df).collect()}
    want = {(c, r.id) for r in df.collect() for c in ("x", "y", "z", "s", "b") if r[c] is not None and p[r.id][f"{c}_pred"] > 0.3}
    assert want and {(r.column, r.id) for r in found.collect()} == want
    before = guess.models_["y"]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        test = guess.gen_test_df(df, thresh=0.3, m=0.01, use_exist=True)
    assert guess.models_["y"] is before
    few = {str(w.message).split(" cells of ")[1].split(" ")[0] for w in said if " cells of " in str(w.message)}
    assert few == {c for c in ("x", "y", "z", "s", "b") if sum(a == c for a, _ in want) <= 3} and "x" in few
    assert rows(test) == rows(cells.blanked(df, found, ["id", "at"]))
    # x tells whether y is missing
    assert sum(r.y_pred > 0.5 for r in p.values()) > 20 and all(r.y_pred < 0.6 for r in p.values() if r.x < 18)
    assert rows(MissingnessClassifier(Stump(), key=["id"]).fit_predict(df)) == rows(MissingnessClassifier(Stump(), key=["id"]).fit(df).predict(df))
    with pytest.raises(ValueError, match="same columns"):
        guess.predict(df.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="same columns"):
        guess.predict(df.drop("z"))
    with pytest.raises(ValueError, match="fit comes first"):
        MissingnessClassifier().predict(df)
    for bad in (VectorAssembler(), object(), "tree"):
        with pytest.raises(TypeError):
            MissingnessClassifier(bad)


def test_times_and_many_levels(spark):
    """Dates are no predictors; a string of 10,000 levels is one, by hash buckets; 300 numbers and levels take matrix products."""
    df = spark.range(20_000).select("id", F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("u"), (F.col("id") % 10_000).cast("string")).alias("u"), F.concat(F.lit("g"), (F.col("id") % 100).cast("string")).alias("g"), F.when(F.xxhash64("id") % 5 != 0, (F.col("id") % 100) * 2.0).alias("v"), F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("w"))
    got = SingleImputer({"v": "least squares", "w": "default predictive"}, predictors={"v": ["u", "g", "ts"]}, key=["id"]).fit_transform(df)
    assert got.where("v IS NULL OR w IS NULL").isEmpty()
    # 100 levels tell all of v
    assert got.where("abs(v - id % 100 * 2) > 1e-6").isEmpty()
    guess = MissingnessClassifier(Stump(), key=["id"]).fit(df)
    done = guess.predict_proba(df.limit(50)).collect()
    assert all(r.ts_pred == 0 for r in done) and guess.spans_["u"][1] == regression.BUCKETS and "ts" not in guess.spans_
    with pytest.raises(ValueError, match="timestamp"):
        SingleImputer({"v": "mean"}, key=["id"]).fit(df.withColumn("ts", F.when(F.col("id") > 3, F.col("ts"))))


def test_sums_by_matrix_products(spark, monkeypatch):
    df = frame(spark).withColumn("g", (F.col("id") % 2).cast("int")).repartition(7)
    narrow = regression.many_fits(df, {"y": ["x", "z", "s"], "z": ["x"]}, "g")
    monkeypatch.setattr(regression, "WIDE", 0)
    wide = regression.many_fits(df, {"y": ["x", "z", "s"], "z": ["x"]}, "g")
    for c in ("y", "z"):
        assert narrow[c].keys() == wide[c].keys() == {0, 1}
        for g in range(2):
            one = regression.least_squares(df.where(F.col("g") == g), c, ["x", "z", "s"] if c == "y" else ["x"])
            for m in (narrow[c][g], wide[c][g]):
                assert m.n == one.n and np.allclose(m.beta, one.beta, atol=1e-9) and np.allclose(m.cov, one.cov, atol=1e-9) and np.isclose(m.mse, one.mse)


def quadrature(x, y, am, asd, bm, bsd, sig):
    """Mean and covariance of (alpha, beta), and the mean of sigma, by sums over a grid of sigma."""
    design = np.column_stack([np.ones(len(x)), x])
    prior = np.diag([asd**-2] + [bsd**-2] * x.shape[1])
    centre = np.array([am] + [bm] * x.shape[1])
    grid = np.exp(np.linspace(-4, 5, 3000))
    logs, means, covs = [], [], []
    for s in grid:
        p = prior + design.T @ design / s**2
        b = np.linalg.solve(p, prior @ centre + design.T @ y / s**2)
        logs.append(-len(y) * np.log(s) - np.linalg.slogdet(p)[1] / 2 - (y @ y / s**2 + centre @ prior @ centre - b @ p @ b) / 2 - np.log(1 + (s / sig) ** 2) + np.log(s))
        means.append(b)
        covs.append(np.linalg.inv(p))
    w = np.exp(np.array(logs) - max(logs))
    w, means = w / w.sum(), np.array(means)
    mean = w @ means
    return mean, np.einsum("i,ijk", w, np.array(covs)) + ((means - mean).T * w) @ (means - mean), w @ grid


@pytest.mark.parametrize("prior", [{}, {"am": 2.0, "asd": 0.5, "bm": 1.0, "bsd": 0.2, "sig": 0.3}, {"asd": 100.0, "bsd": 100.0, "sig": 25.0}])
def test_gibbs_agrees_with_quadrature(prior):
    rng = np.random.default_rng(4)
    x = rng.normal(30, 4, (40, 2)) @ np.array([[1, 0.6], [0, 1]])
    y = 1 + x @ [0.4, -0.2] + rng.normal(0, 1.5, 40)
    mid = np.append(x.mean(axis=0), y.mean())
    z = np.column_stack([x, y]) - mid
    got = posterior.gibbs(posterior.Sums(40, mid, z.T @ z), **prior, sample=20_000, seed=1)
    mean, cov, sigma = quadrature(x, y, *[{"am": 0.0, "asd": 10.0, "bm": 0.0, "bsd": 10.0, "sig": 1.0, **prior}[c] for c in posterior.PRIORS])
    sd = np.sqrt(np.diag(cov))
    assert (np.abs(got.mean - mean) < 0.02 * sd).all() and (np.abs(got.coefs.mean(axis=0) - mean) < 0.1 * sd).all()
    assert np.allclose(got.coefs.std(axis=0), sd, rtol=0.05) and np.isclose(got.sigma.mean(), sigma, rtol=0.02)


def test_flat_priors_and_odd_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (50, 2))
    x[:, 1] = 2 * x[:, 0]
    y = 3 * x[:, 0] + rng.normal(0, 0.1, 50)
    mid = np.append(x.mean(axis=0), y.mean())
    z = np.column_stack([x, y]) - mid
    got = posterior.gibbs(posterior.Sums(50, mid, z.T @ z), asd=np.inf, bsd=np.inf, sample=300, tune=100)
    assert np.isfinite(got.coefs).all() and np.allclose(got.mean[1] + 2 * got.mean[2], 3, atol=0.1)
    none = posterior.gibbs(posterior.Sums(3, np.array([5.0]), np.array([[2.0]])), sample=50, tune=10)
    assert none.coefs.shape == (50, 1) and none.draw(np.random.default_rng(0), joint=False).shape == (1,)
    with pytest.raises(ValueError):
        posterior.gibbs(posterior.Sums(3, np.array([5.0]), np.array([[2.0]])), asd=0.0)


def test_priors_pull_imputations(spark):
    df = frame(spark).select("id", "x", "y")
    gap = df.where("y IS NULL")
    cell = lambda how, **kw: {r.id: r.y for r in regression.fill(df, "y", how, ["x"], ["id"], 1, **kw).join(gap.select("id"), "id").collect()}
    plain, near, far = cell("least squares"), cell("bayesian least squares", asd=1e3, bsd=1e3), cell("bayesian least squares", am=0.0, asd=1e-6, bm=0.0, bsd=1e-6)
    assert all(abs(plain[i] - near[i]) < 0.1 for i in plain) and all(abs(v) < 0.01 for v in far.values())
    each, noisy = cell("bayesian least squares", asd=10.0, fill_value="random"), cell("bayesian least squares", asd=10.0, fill_value="random", predictive=True)
    spread = lambda a: np.std([a[i] - plain[i] for i in plain])
    assert 0 < spread(each) < 0.5 * spread(noisy) and 0.4 < spread(noisy) < 1.2
    seen = {r.y for r in df.where("y IS NOT NULL").collect()}
    for kw in ({"am": 0.0, "asd": 1.0, "bm": 3.0, "bsd": 0.1, "sig": 1.0}, {"sig": 2.0, "joint": True}, {"joint": False}):
        got = cell("pmm", **kw)
        assert set(got.values()) <= seen and cell("pmm", **kw) == got
    assert cell("pmm", sig=1.0) != cell("pmm", sig=1.0, joint=True)


def test_residual_of_lrd(spark):
    """One donor, whose prediction is its value: plain adds donor's prediction less the cell's, classic the other way round."""
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 2.0), (3, 10.0, 20.0), (4, 4.0, None)], "id long, x double, y double")
    model = regression.least_squares(df, "y", ["x"])
    value = lambda residual: regression.matched(df, "y", model.predict(df), regression.pool(df, "y", model.predict(df), ["x"], ["id"]), ["id"], 1, 1, residual).where("id = 4").first().y
    assert value(None) == 2.0 and value("plain") == pytest.approx(2.0 + (2.0 - 8.0)) and value("classic") == pytest.approx(8.0)


def test_donors_are_those_of_the_fit(spark):
    df = frame(spark).select("id", "x", "y")
    model = SingleImputer({"y": "pmm"}, key=["id"], seed=1).fit(df)
    new = df.withColumn("y", F.lit(None).cast("double")).where("id < 40")
    assert {r.y for r in model.transform(new).collect()} <= {r.y for r in df.where("y IS NOT NULL").collect()}


def test_missing_predictors_count_as_their_mean_among_rows_to_fill(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0), (4, None, None), (5, 10.0, None), (6, 20.0, None)], "id long, x double, y double")
    got = {r.id: r.y for r in regression.fill(df, "y", "least squares", ["x"], ["id"]).collect()}
    assert got[4] == pytest.approx(30.0) and got[5] == pytest.approx(20.0)
    lone = df.where("id < 5")
    assert regression.fill(lone, "y", "least squares", ["x"], ["id"]).where("id = 4").first().y == pytest.approx(0.0)


def test_chained_rounds_of_numbers_and_strings(spark):
    df = frame(spark)
    spec = {"y": "pmm", "z": "lrd", "b": "multinomial logistic", "s": "categorical"}
    first = MultipleImputer(n=2, strategy=spec, key=["id"], seed=4).fit_transform(df)
    for chained in (False, True):
        got = MiceImputer(k=2, n=2, strategy=spec, key=["id"], seed=4, chained=chained).fit_transform(df)
        assert got.count() == 800 and got.where("y IS NULL OR z IS NULL OR b IS NULL OR s IS NULL").isEmpty()
        # what depends on no other column stays, the rest is drawn anew
        assert rows(got.select("imp_num", "id", "s")) == rows(first.select("imp_num", "id", "s"))
        assert rows(got.select("imp_num", "id", "y")) != rows(first.select("imp_num", "id", "y"))
        parts = got.groupBy("imp_num").agg(F.avg("y"), F.stddev("y")).collect()
        assert all(abs(r[1] - 49) < 4 for r in parts)


def test_pooled_options(spark):
    df = frame(spark).drop("day", "at", "s")
    mi = MultipleImputer(n=3, strategy={"y": "stochastic", "z": "mean"}, predictors={"y": ["x"]}, key=["id"], seed=1)
    whole, bare = MiLinearRegression(mi).fit(df, "y", ["x", "z"]), MiLinearRegression(mi, variances=False).fit(df, "y", ["x", "z"])
    assert np.allclose(whole.statistics_["coefs"], bare.statistics_["coefs"]) and bare.summary(spark).columns == ["term", "coefs"]
    own = [regression.least_squares(d, "y", ["x", "z"]).beta for d in mi.fit(df).each(df)]
    assert np.allclose(whole.statistics_["coefs"], np.mean(own, axis=0)) and np.allclose(whole.statistics_["vb"], np.var(own, axis=0, ddof=1))
    assert MiLinearRegression(mi_kwgs={"k": 2, "n": 2, "strategy": {"y": "mean"}, "key": ["id"]}).imputer.getOrDefault("k") == 2
    ridged = MiLogisticRegression(mi, model_kwgs={"ridge": 5.0}).fit(df.withColumn("b", F.when(F.col("x") > 16, "hi").otherwise("lo")), "b", ["z"])
    assert len(ridged.statistics_["coefs"]) == 2
    with pytest.raises(TypeError):
        MiLinearRegression(SingleImputer())
    with pytest.raises(ValueError):
        MiLinearRegression(mi, mi_kwgs={"k": 2})
