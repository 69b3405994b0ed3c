"""Queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from random import Random
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir
from ..operators import checks, patterns, plots, regression, temporal, univariate
from ..operators.classifier import Stump
from ..operators.imputers import MissingnessClassifier, MiceImputer, MultipleImputer, SingleImputer
from ..operators.pooling import MiLinearRegression, MiLogisticRegression, percent_bias, raw_bias
from ..operators.strategies import Strategy
from ..sources.masked import masked, masked_sql

ORDERS = ["o_totalprice", "o_orderstatus", "o_orderpriority"]


def _orders(spark, d: str, *keep: str) -> DataFrame:
    return masked(spark, d, "orders", *keep)


def _cells(spark, d: str) -> DataFrame:
    return _orders(spark, d).select(*ORDERS)


def _rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def _impute(strategy: dict, **kw):
    def run(spark, d: str) -> DataFrame:
        df = _orders(spark, d)
        return SingleImputer(strategy, key=["o_orderkey"], **kw).fit_transform(df.select("o_orderkey", *strategy))

    return run


def _series(how, **kw):
    def run(spark, d: str) -> DataFrame:
        df = masked(spark, d, "events", "user_id", "ts").select("event_id", "user_id", "ts", "value")
        return _rounded(how(df, "value", ["ts", "event_id"], ["user_id"], **kw).select("event_id", "value"), "value", digits=6)

    return run


def _numeric(spark, d: str) -> DataFrame:
    return _orders(spark, d, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


def _regress(strategy: str, digits: int = 4):
    def run(spark, d: str) -> DataFrame:
        out = regression.fill(_numeric(spark, d), "o_totalprice", strategy, ["o_custkey"], ["o_orderkey"], 7)
        return _rounded(out.select("o_orderkey", "o_totalprice"), "o_totalprice", digits=digits)

    return run


def _mixed(strategy: str, target: str):
    return lambda spark, d: regression.fill(_orders(spark, d), target, strategy, [c for c in ORDERS if c != target], ["o_orderkey"], 7)


def _multiple(cls, **kw):
    def run(spark, d: str) -> DataFrame:
        out = cls(n=3, strategy={"o_totalprice": "stochastic"}, predictors={"o_totalprice": ["o_custkey"]}, key=["o_orderkey"], seed=3, **kw).fit_transform(_numeric(spark, d))
        return _rounded(out, "o_totalprice", digits=2)

    return run


def _pooled(spark, d: str) -> DataFrame:
    mi = MultipleImputer(n=5, strategy={"o_totalprice": "stochastic"}, predictors={"o_totalprice": ["o_custkey"]}, key=["o_orderkey"], seed=3)
    return MiLinearRegression(mi).fit(_numeric(spark, d), "o_totalprice", ["o_custkey"]).summary(spark)


def _two_valued(spark, d: str) -> DataFrame:
    return _orders(spark, d, "o_custkey").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderstatus <> 'F' THEN 'other' ELSE o_orderstatus END"))


def _pooled_logistic(spark, d: str) -> DataFrame:
    mi = MultipleImputer(n=3, strategy={"o_totalprice": "stochastic", "o_orderstatus": "categorical"}, predictors={"o_totalprice": ["o_custkey"]}, key=["o_orderkey"], seed=3)
    df = _two_valued(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return MiLogisticRegression(mi).fit(df, "o_orderstatus", ["o_totalprice", "o_custkey"]).summary(spark)


def _means(cls=MultipleImputer, **kw):
    return cls(strategy={"o_totalprice": "mean"}, key=["o_orderkey"], **kw)


def _bias(spark, d: str) -> DataFrame:
    """Of a regression on mean-filled cells, against that on the complete table."""
    model = MiLinearRegression(_means(n=2)).fit(_numeric(spark, d), "o_totalprice", ["o_custkey"])
    true = regression.least_squares(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", ["o_custkey"]).beta
    pooled = model.statistics_["coefs"]
    rows = [(t, float(a), float(b)) for t, a, b in zip(model.terms_, raw_bias(pooled, true), percent_bias(pooled, true))]
    return _rounded(_rounded(spark.createDataFrame(rows, "term string, raw_bias double, percent_bias double"), "raw_bias", digits=4), "percent_bias", digits=5)


LINES = ["l_quantity", "l_extendedprice"]


def _mutual(**kw):
    """Two incomplete columns that predict each other."""

    def run(spark, d: str) -> DataFrame:
        df = masked(spark, d, "lineitem").select("l_key", *LINES)
        mi = MiceImputer(n=2, strategy=dict.fromkeys(LINES, "stochastic"), predictors={a: [b] for a, b in zip(LINES, LINES[::-1])}, key=["l_key"], seed=5, **kw)
        return _rounded(mi.fit_transform(df), *LINES, digits=3)

    return run


def _pipeline(spark, d: str) -> DataFrame:
    """An imputer as a stage of a pipeline whose model is written and loaded again."""
    stages = [SingleImputer({"o_totalprice": "mean", "o_orderstatus": "categorical"}, key=["o_orderkey"], seed=1), SQLTransformer(statement="SELECT o_orderkey, o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice FROM __THIS__")]
    path = f"{shared_dir(spark)}/lacuna-pipeline-{uuid4().hex}"
    df = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus")
    Pipeline(stages=stages).fit(df).save(path)
    return PipelineModel.load(path).transform(df)


def _imputed_cells(spark, d: str) -> DataFrame:
    df = _orders(spark, d)
    return SingleImputer(dict.fromkeys(ORDERS[:2], "mode"), key=["o_orderkey"]).fit(df).imputed_(df)


def _test_indices(spark, d: str) -> DataFrame:
    df = _orders(spark, d, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    guess = MissingnessClassifier(Stump(), {"o_totalprice": ["o_custkey"], "o_orderstatus": ["o_custkey"]}, key=["o_orderkey"])
    return guess.gen_test_indices(df, thresh=0.15)


class Midrange(Strategy):
    """The middle between the smallest and the largest observed value: a strategy of one's own."""

    name = "midrange"

    def fit(self, df, ask):
        low, high = df.agg(F.min(ask.column), F.max(ask.column)).first()
        return {"middle": (low + high) / 2}, {}

    def fill(self, df, ask, params, tables):
        return df.withColumn(ask.column, F.coalesce(ask.column, F.lit(params["middle"])))


def _nan(spark, d: str) -> DataFrame:
    df = masked(spark, d, "orders", nan=True)
    return _rounded(SingleImputer({"o_totalprice": "mean"}, key=["o_orderkey"]).fit_transform(df.select("o_orderkey", "o_totalprice")), "o_totalprice", digits=4)


def _with_priors(spark, d: str) -> DataFrame:
    """The posterior's mean under priors that pull; no closed form, as sigma is unknown."""
    out = regression.fill(_numeric(spark, d), "o_totalprice", "bayesian least squares", ["o_custkey"], ["o_orderkey"], 7, am=100_000.0, asd=1000.0, bm=0.0, bsd=1.0, sig=50_000.0)
    return _rounded(out.select("o_orderkey", "o_totalprice"), "o_totalprice", digits=4)


QUERIES = {
    "flux": lambda s, d: _rounded(patterns.flux(_cells(s, d)), "pobs", "influx", "outflux", "ainb", "aout"),
    "md_pairs": lambda s, d: patterns.md_pairs(_cells(s, d)),
    "md_pattern": lambda s, d: patterns.md_pattern(_cells(s, d)),
    "md_locations": lambda s, d: patterns.md_locations(_cells(s, d), both=True),
    "proportions": lambda s, d: _rounded(patterns.proportions(_cells(s, d)), "poms", "pobs"),
    "inbound": lambda s, d: _rounded(patterns.inbound(_cells(s, d)), "inbound"),
    "outbound": lambda s, d: _rounded(patterns.outbound(_cells(s, d)), "outbound"),
    "nullity_cov": lambda s, d: _rounded(patterns.nullity_cov(_cells(s, d)), "cov"),
    "nullity_corr": lambda s, d: _rounded(patterns.nullity_corr(_cells(s, d)), "corr"),
    "listwise_delete": lambda s, d: checks.listwise_delete(_orders(s, d)),
    "impute_mean": lambda s, d: _rounded(_impute({"o_totalprice": "mean"})(s, d), "o_totalprice", digits=4),
    "impute_median": lambda s, d: _rounded(_impute({"o_totalprice": "median"})(s, d), "o_totalprice", digits=4),
    "impute_mode": _impute({"o_orderstatus": "mode", "o_orderpriority": "mode"}),
    "impute_random": _impute({"o_orderpriority": "random"}, seed=1),
    "impute_categorical": _impute({"o_orderstatus": "categorical"}, seed=1),
    "impute_norm": lambda s, d: _rounded(_impute({"o_totalprice": "norm"}, seed=1)(s, d), "o_totalprice", digits=2),
    "impute_norm_unit": lambda s, d: _rounded(_impute({"o_totalprice": "normal unit variance"}, seed=1)(s, d), "o_totalprice", digits=2),
    "impute_default_univariate": lambda s, d: _rounded(_impute({"o_totalprice": "default univariate", "o_orderstatus": "default univariate"})(s, d), "o_totalprice", digits=4),
    "locf": _series(temporal.locf),
    "nocb": _series(temporal.nocb),
    "locf_mean": _series(temporal.locf, start="mean"),
    "interpolate_linear": _series(temporal.interpolate),
    "interpolate_time": _series(temporal.interpolate, method="time"),
    "interpolate_cubic": _series(temporal.interpolate, method="cubic"),
    "least_squares": _regress("least squares"),
    "stochastic": _regress("stochastic", digits=2),
    "bayesian_least_squares": _regress("bayesian least squares"),
    "pmm": _regress("pmm"),
    "lrd": _regress("lrd"),
    "binary_logistic": lambda s, d: regression.fill(_orders(s, d).withColumn("o_orderstatus", F.expr("CASE WHEN o_orderstatus <> 'F' THEN 'other' ELSE o_orderstatus END")), "o_orderstatus", "binary logistic", ["o_totalprice"], ["o_orderkey"]),
    "multinomial_logistic": _mixed("multinomial logistic", "o_orderstatus"),
    "multiple_imputation": _multiple(MultipleImputer),
    "mice": _multiple(MiceImputer, k=2),
    "pooled_regression": _pooled,
    "pooled_logistic": _pooled_logistic,
    "bayesian_binary_logistic": lambda s, d: regression.fill(_two_valued(s, d), "o_orderstatus", "bayesian binary logistic", ["o_totalprice"], ["o_orderkey"]),
    "bias": _bias,
    "influx": lambda s, d: _rounded(patterns.influx(_cells(s, d)), "influx"),
    "outflux": lambda s, d: _rounded(patterns.outflux(_cells(s, d)), "outflux"),
    "plot_percent": lambda s, d: _rounded(plots.percent(_cells(s, d)), "percent"),
    "plot_distances": lambda s, d: _rounded(plots.distances(_cells(s, d)), "distance"),
    "plot_scatter": lambda s, d: _rounded(plots.scatter(_numeric(s, d), _means(SingleImputer), "o_custkey", "o_totalprice"), "y", digits=4),
    "plot_melted": lambda s, d: _rounded(plots.melted(_numeric(s, d), _means(n=2), "o_totalprice"), "value", digits=4),
    "plot_histogram": lambda s, d: _rounded(plots.histogram(_numeric(s, d), _means(n=2), "o_totalprice"), "low", "high", digits=4),
    "plot_boxplots": lambda s, d: _rounded(plots.boxplots(_numeric(s, d), _means(n=2), "o_totalprice"), "min", "q1", "median", "q3", "max", digits=4),
    "mice_mutual": _mutual(k=2),
    "mice_chained": _mutual(k=3, chained=True),
    "ml_pipeline": _pipeline,
    "imputed_cells": _imputed_cells,
    "test_indices": _test_indices,
    "custom_strategy": lambda s, d: _rounded(_impute({"o_totalprice": Midrange()})(s, d), "o_totalprice", digits=4),
    "impute_mean_nan": _nan,
    "bayesian_priors": _with_priors,
    "pooled_coefs": lambda s, d: _rounded(MiLinearRegression(_means(n=2), variances=False).fit(_numeric(s, d), "o_totalprice", ["o_custkey"]).summary(s), "coefs"),
    "plot_density": lambda s, d: _rounded(_rounded(plots.density(_numeric(s, d), _means(n=2), "o_totalprice"), "x", digits=4), "density", digits=13),
    "pairs_matrix": lambda s, d: patterns.as_matrix(patterns.md_pairs(_cells(s, d)), "rm", ORDERS),
    "missingness_classifier": lambda s, d: MissingnessClassifier(key=["o_orderkey"]).fit(_orders(s, d)).predict(_orders(s, d)),
}

_O = f"WITH t AS ({masked_sql('orders')})"
_N = f"WITH t AS ({masked_sql('orders', 'o_custkey')})"
_E = f"WITH t AS ({masked_sql('events', 'user_id', 'ts')})"
_LONG = ", r AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS r{i}" for i, c in enumerate(ORDERS)) + " FROM t), p AS ("
_LONG += " UNION ALL ".join(f"SELECT '{a}' AS var_j, '{b}' AS var_k, CAST(SUM(r{i}*r{j}) AS BIGINT) AS rr, CAST(SUM(r{i}*(1-r{j})) AS BIGINT) AS rm, CAST(SUM((1-r{i})*r{j}) AS BIGINT) AS mr, CAST(SUM((1-r{i})*(1-r{j})) AS BIGINT) AS mm FROM r" for i, a in enumerate(ORDERS) for j, b in enumerate(ORDERS)) + ")"
_COV = _O + _LONG + ", c AS (SELECT var_j, var_k, (mm - (mr+mm)*1.0*(rm+mm)/(rr+rm+mr+mm))/(rr+rm+mr+mm-1) AS cov FROM p)"
_FLUX = "SELECT var_j AS \"column\", ROUND(MAX(CASE WHEN var_j=var_k THEN rr*1.0/(rr+mm) END),8) AS pobs, ROUND(SUM(mr)*1.0/SUM(mr+rr),8) AS influx, ROUND(SUM(rm)*1.0/SUM(rm+mm),8) AS outflux, ROUND(SUM(CASE WHEN var_j<>var_k THEN mr*1.0/(mr+mm) END)/2,8) AS ainb, ROUND(SUM(CASE WHEN var_j<>var_k THEN rm*1.0/(rm+rr) END)/2,8) AS aout FROM p GROUP BY var_j"


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


_BOTH = "MAX(CASE WHEN value IS NOT NULL THEN {at} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, MIN(CASE WHEN value IS NOT NULL THEN {at} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b"
_LERP = _E + ", n AS (SELECT *, {at} AS n FROM t), k AS (SELECT *, LAST_VALUE(value IGNORE NULLS) OVER u AS va, FIRST_VALUE(value IGNORE NULLS) OVER d AS vb, " + _BOTH.format(at="n") + " FROM n WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, ROUND(COALESCE(value, va + (vb-va)/NULLIF(b-a,0)*(n-a), va, vb), 6) AS value FROM k"
_FILL = "LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BACK = "FIRST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_WHOLE = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

ORACLE_SQL = {
    "flux": f"{_O}{_LONG} {_FLUX}",
    "md_pairs": f"{_O}{_LONG} SELECT * FROM p",
    "md_pattern": f"{_O}, r AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS {c}" for c in ORDERS) + f" FROM t) SELECT {', '.join(ORDERS)}, COUNT(*) AS count, 3 - {' - '.join(ORDERS)} AS nmis FROM r GROUP BY {', '.join(ORDERS)}",
    "md_locations": f"{_O} SELECT {', '.join(ORDERS)}, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in ORDERS) + " FROM t",
    "proportions": f"{_O}{_LONG}, f AS ({_FLUX}) SELECT \"column\", ROUND(1 - pobs, 8) AS poms, pobs FROM f",
    "inbound": f"{_O}{_LONG} SELECT var_j, var_k, ROUND(mr*1.0/(mr+mm), 8) AS inbound FROM p",
    "outbound": f"{_O}{_LONG} SELECT var_j, var_k, ROUND(rm*1.0/(rm+rr), 8) AS outbound FROM p",
    "nullity_cov": f"{_COV} SELECT var_j, var_k, ROUND(cov, 8) AS cov FROM c",
    "nullity_corr": f"{_COV} SELECT c.var_j, c.var_k, ROUND(c.cov / SQRT(a.cov * b.cov), 8) AS corr FROM c JOIN c a ON a.var_j = c.var_j AND a.var_k = c.var_j JOIN c b ON b.var_j = c.var_k AND b.var_k = c.var_k",
    "listwise_delete": f"{_O} SELECT * FROM t WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ORDERS),
    "impute_mean": f"{_O} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, AVG(o_totalprice) OVER ()), 4) AS o_totalprice FROM t",
    "impute_median": f"{_O} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, MEDIAN(o_totalprice) OVER ()), 4) AS o_totalprice FROM t",
    "impute_mode": f"{_O} SELECT o_orderkey, COALESCE(o_orderstatus, {_mode_sql('o_orderstatus')}) AS o_orderstatus, COALESCE(o_orderpriority, {_mode_sql('o_orderpriority')}) AS o_orderpriority FROM t",
    "locf": f"{_E} SELECT event_id, ROUND(COALESCE({_FILL}, FIRST_VALUE(value IGNORE NULLS) {_WHOLE}), 6) AS value FROM t",
    "nocb": f"{_E} SELECT event_id, ROUND(COALESCE({_BACK}, LAST_VALUE(value IGNORE NULLS) {_WHOLE}), 6) AS value FROM t",
    "locf_mean": f"{_E} SELECT event_id, ROUND(COALESCE({_FILL}, AVG(value) {_WHOLE}), 6) AS value FROM t",
    "interpolate_linear": _LERP.format(at="ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)"),
    "interpolate_time": _LERP.format(at="CAST(EPOCH_US(ts) AS DOUBLE)"),
    "least_squares": f"{_N} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, (SELECT REGR_INTERCEPT(o_totalprice, o_custkey) FROM t) + (SELECT REGR_SLOPE(o_totalprice, o_custkey) FROM t) * o_custkey), 4) AS o_totalprice FROM t",
}
_FILLED = _N + ", a AS (SELECT AVG(o_totalprice) AS m FROM t), s AS (SELECT o_custkey, COALESCE(o_totalprice, m) AS value, o_totalprice IS NULL AS imputed FROM t, a), v AS (SELECT UNNEST([1, 2]) AS imp_num), l AS (SELECT 0 AS imp_num, value FROM s WHERE NOT imputed UNION ALL SELECT imp_num, value FROM s, v)"
_FITS = ", r AS (SELECT REGR_INTERCEPT(value, o_custkey) AS i, REGR_SLOPE(value, o_custkey) AS s FROM s), o AS (SELECT REGR_INTERCEPT(o_totalprice, o_custkey) AS i, REGR_SLOPE(o_totalprice, o_custkey) AS s FROM orders), b AS (SELECT 'const' AS term, r.i AS a, o.i AS b FROM r, o UNION ALL SELECT 'o_custkey', r.s, o.s FROM r, o)"
ORACLE_SQL |= {
    "influx": f"{_O}{_LONG}, f AS ({_FLUX}) SELECT \"column\", influx FROM f",
    "outflux": f"{_O}{_LONG}, f AS ({_FLUX}) SELECT \"column\", outflux FROM f",
    "plot_percent": f"{_O}{_LONG} SELECT var_j AS \"column\", mm AS n_missing, ROUND(100.0 * mm / (rr + mm), 8) AS percent FROM p WHERE var_j = var_k",
    "plot_distances": f"{_O}{_LONG} SELECT var_j, var_k, ROUND(SQRT(rm + mr), 8) AS distance FROM p",
    "plot_scatter": f"{_FILLED} SELECT o_custkey AS x, ROUND(value, 4) AS y, imputed FROM s",
    "plot_melted": f"{_FILLED} SELECT imp_num, ROUND(value, 4) AS value, imputed FROM s, v",
    "plot_histogram": f"{_FILLED}, e AS (SELECT MIN(value) AS lo, (MAX(value) - MIN(value)) / 50 AS w FROM l), g AS (SELECT imp_num, CAST(LEAST(FLOOR((value - lo) / w), 49) AS INTEGER) AS bin, COUNT(*) AS count FROM l, e GROUP BY ALL) SELECT imp_num, bin, ROUND(lo + w * bin, 4) AS low, ROUND(lo + w * (bin + 1), 4) AS high, count FROM g, e",
    "plot_boxplots": f"{_FILLED} SELECT imp_num, COUNT(value) AS count, ROUND(MIN(value), 4) AS min, ROUND(QUANTILE_CONT(value, 0.25), 4) AS q1, ROUND(MEDIAN(value), 4) AS median, ROUND(QUANTILE_CONT(value, 0.75), 4) AS q3, ROUND(MAX(value), 4) AS max FROM l GROUP BY imp_num",
    "bias": f"{_FILLED}{_FITS} SELECT term, ROUND(a - b, 4) AS raw_bias, ROUND(100 * ABS(a - b) / b, 5) AS percent_bias FROM b",
}
# its mean under flat priors is the least squares solution
ORACLE_SQL["bayesian_least_squares"] = ORACLE_SQL["least_squares"]


def _drawn_sql(seed: int, salt: str, key: str = "o_orderkey") -> str:
    return f"CAST('0x' || SUBSTR(MD5('{seed}|{salt}|' || {key}), 1, 13) AS BIGINT)"


def _normal_sql(seed: int, salt: str) -> str:
    r, a = [f"((CAST({_drawn_sql(seed, salt + x)} AS DOUBLE) + 0.5) / CAST({1 << 52} AS DOUBLE))" for x in ("/r", "/a")]
    return f"SQRT(-2 * LN({r})) * COS(2 * PI() * {a})"


def _pick_sql(column: str, seed: int, weight: str, tied: bool = False) -> str:
    """``t`` with ``column`` filled as filled_<column>: values lie in the order of their md5, each as long as its weight."""
    most = "WHERE n = (SELECT MAX(n) FROM c)" if tied else ""
    return (
        f"c AS (SELECT {column} AS value, COUNT(*) AS n FROM t WHERE {column} IS NOT NULL GROUP BY {column}), w AS (SELECT value, {weight} AS w, SUBSTR(MD5(value), 1, 13) AS h FROM c {most}), "
        f"r AS (SELECT value, SUM(w) OVER (ORDER BY h, value) - w AS lo, SUM(w) OVER (ORDER BY h, value) AS hi FROM w), "
        f"f AS (SELECT t.*, COALESCE({column}, r.value) AS filled_{column} FROM (SELECT *, {_drawn_sql(seed, column)} % (SELECT SUM(w) FROM w) AS u FROM t) t LEFT JOIN r ON {column} IS NULL AND u >= lo AND u < hi)"
    )


_STOCHASTIC = _N + ", g AS (SELECT REGR_INTERCEPT(o_totalprice, o_custkey) AS i, REGR_SLOPE(o_totalprice, o_custkey) AS s, SQRT((REGR_SYY(o_totalprice, o_custkey) - POWER(REGR_SXY(o_totalprice, o_custkey), 2) / REGR_SXX(o_totalprice, o_custkey)) / REGR_COUNT(o_totalprice, o_custkey)) AS sd FROM t) "


def _stochastic_sql(seed: int, head: str = "o_orderkey") -> str:
    return f"SELECT {head}, ROUND(COALESCE(o_totalprice, i + s * o_custkey + sd * {_normal_sql(seed, 'o_totalprice')}), 2) AS o_totalprice FROM t, g"


def _imputations_sql(seeds: list[int]) -> str:
    return _STOCHASTIC + " UNION ALL ".join(_stochastic_sql(x, f"CAST({i + 1} AS INTEGER) AS imp_num, o_orderkey, o_custkey") for i, x in enumerate(seeds))


_SHARED = Random("1/o_totalprice").gauss(0, 1)
ORACLE_SQL |= {
    "impute_random": f"{_O}, {_pick_sql('o_orderpriority', 1, '1')} SELECT o_orderkey, filled_o_orderpriority AS o_orderpriority FROM f",
    "impute_categorical": f"{_O}, {_pick_sql('o_orderstatus', 1, 'n')} SELECT o_orderkey, filled_o_orderstatus AS o_orderstatus FROM f",
    "impute_default_univariate": f"{_O}, {_pick_sql('o_orderstatus', 0, '1', tied=True)} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, AVG(o_totalprice) OVER ()), 4) AS o_totalprice, filled_o_orderstatus AS o_orderstatus FROM f",
    "impute_norm": f"{_O} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, AVG(o_totalprice) OVER () + STDDEV_SAMP(o_totalprice) OVER () * {_normal_sql(1, 'o_totalprice')}), 2) AS o_totalprice FROM t",
    "impute_norm_unit": f"{_O} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, AVG(o_totalprice) OVER () + CAST('{_SHARED!r}' AS DOUBLE) / SQRT(COUNT(o_totalprice) OVER ()) + {_normal_sql(1, 'o_totalprice')}), 2) AS o_totalprice FROM t",
    "stochastic": _STOCHASTIC + _stochastic_sql(7),
    "multiple_imputation": _imputations_sql([4, 17, 30]),
    # the second round fits on the same observed cells and draws anew
    "mice": _imputations_sql([1004, 1017, 1030]),
}


def _fit_sql(y: str, x: str, source: str, group: str = "") -> str:
    """Intercept, slope and the root of the mean square error of y on x, for each group."""
    by = f"GROUP BY {group}" if group else ""
    mse = f"(REGR_SYY({y}, {x}) - POWER(REGR_SXY({y}, {x}), 2) / REGR_SXX({y}, {x})) / REGR_COUNT({y}, {x})"
    return f"SELECT {group + ', ' if group else ''}REGR_INTERCEPT({y}, {x}) AS i, REGR_SLOPE({y}, {x}) AS s, SQRT(GREATEST({mse}, 0)) AS sd FROM {source} {by}"


def _mutual_sql(k: int, chained: bool) -> str:
    """The rounds of both columns, step by step: q is quantity, p price; q1, p1 are as filled by round 1."""
    q, p = LINES
    noise = lambda r, j, c: "CASE n.imp_num " + " ".join(f"WHEN {i + 1} THEN {_normal_sql(6 + 13 * i + 1000 * r + j, c).replace('o_orderkey', 'n.l_key')}" for i in range(2)) + " END"
    steps = [f"WITH t AS ({masked_sql('lineitem')})", f"b AS (SELECT v.imp_num, t.l_key, t.{q} AS q, t.{p} AS p FROM t, (SELECT UNNEST([1, 2]) AS imp_num) v)", "m AS (SELECT AVG(p) AS m FROM b WHERE q IS NULL)"]
    before = "b"
    for r in range(k):
        first = r == 0
        seen_q, seen_p = ("q", "p") if first else (f"q{r - 1}", f"p{r - 1}")
        fit_q = _fit_sql("q", seen_p, before, "imp_num")
        x = seen_p if chained and not first else "COALESCE(n.p, m.m)"
        steps += [f"fq{r} AS ({fit_q})", f"a{r} AS (SELECT n.*, COALESCE(n.q, f.i + f.s * {x} + f.sd * {noise(r, 0, q)}) AS q{r} FROM {before} n JOIN fq{r} f USING (imp_num), m)"]
        fit_p = _fit_sql("p", f"q{r}" if chained and not first else seen_q, f"a{r}", "imp_num")
        steps += [f"fp{r} AS ({fit_p})", f"c{r} AS (SELECT n.*, COALESCE(n.p, f.i + f.s * n.q{r} + f.sd * {noise(r, 1, p)}) AS p{r} FROM a{r} n JOIN fp{r} f USING (imp_num))"]
        before = f"c{r}"
    return ", ".join(steps) + f" SELECT CAST(imp_num AS INTEGER) AS imp_num, l_key, ROUND(q{k - 1}, 3) + CAST(0 AS DOUBLE) AS {q}, ROUND(p{k - 1}, 3) + CAST(0 AS DOUBLE) AS {p} FROM {before}"


_STUMPS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", o_orderkey FROM (SELECT *, AVG(CAST({c} IS NULL AS INTEGER)) OVER (PARTITION BY o_custkey > a) AS share FROM t, m) WHERE {c} IS NOT NULL AND share > 0.15" for c in ORDERS[:2])
ORACLE_SQL |= {
    "mice_mutual": _mutual_sql(2, False),
    "mice_chained": _mutual_sql(3, True),
    "ml_pipeline": f"{_O}, {_pick_sql('o_orderstatus', 1, 'n')} SELECT o_orderkey, filled_o_orderstatus AS o_orderstatus, ROUND(COALESCE(o_totalprice, AVG(o_totalprice) OVER ()), 4) AS o_totalprice FROM f",
    "imputed_cells": _O + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", o_orderkey FROM t WHERE {c} IS NULL" for c in ORDERS[:2]),
    "test_indices": f"{_N}, m AS (SELECT AVG(o_custkey) AS a FROM t) {_STUMPS}",
    "custom_strategy": f"{_O} SELECT o_orderkey, ROUND(COALESCE(o_totalprice, (SELECT (MIN(o_totalprice) + MAX(o_totalprice)) / 2 FROM t)), 4) AS o_totalprice FROM t",
    "impute_mean_nan": ORACLE_SQL["impute_mean"],
    "pooled_coefs": f"{_FILLED}{_FITS} SELECT term, ROUND(a, 8) AS coefs FROM b",
    "plot_density": f"{_FILLED}, e AS (SELECT MIN(value) - (MAX(value) - MIN(value)) / 10 AS lo, (MAX(value) - MIN(value) + 2 * ((MAX(value) - MIN(value)) / 10)) / 99 AS w FROM l), g AS (SELECT imp_num, CAST(FLOOR((value - lo) / w + 0.5) AS INTEGER) AS bin, COUNT(*) AS c FROM l, e GROUP BY ALL), h AS (SELECT imp_num, COUNT(*) AS n, STDDEV_SAMP(value) * POWER(COUNT(*), -0.2) AS h FROM l GROUP BY imp_num), x AS (SELECT CAST(UNNEST(RANGE(100)) AS INTEGER) AS point) SELECT imp_num, point, ROUND(ANY_VALUE(lo + w * point), 4) AS x, ROUND(SUM(c * EXP(-0.5 * POWER((point - bin) * w / h, 2))) / ANY_VALUE(n * h * SQRT(2 * PI())), 13) AS density FROM x, g JOIN h USING (imp_num), e GROUP BY imp_num, point",
    "pairs_matrix": f"{_O}{_LONG} SELECT var_j, " + ", ".join(f"MAX(CASE WHEN var_k = '{c}' THEN rm END) AS {c}" for c in ORDERS) + " FROM p GROUP BY var_j",
}
