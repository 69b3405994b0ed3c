import math
import os

import pytest
from pyspark.sql import functions as F

from lacuna.operators import checks, patterns, pooling, regression, temporal
from lacuna.operators.imputers import SingleImputer
from lacuna.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
GENERAL = list(zip([1, 5, 9, 6, 12, 11, None, None], [2, 4, 3, 6, 11, None, None, None], [-1, 1, None, None, None, -1, 1, 0]))


def _same(a, b):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6)), (x, y)


@pytest.fixture(scope="module")
def general(spark):
    return spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in GENERAL], "A double, B double, C double")


def test_patterns(general):
    pairs = {(r.var_j, r.var_k): (r.rr, r.rm, r.mr, r.mm) for r in patterns.md_pairs(general).collect()}
    assert pairs["A", "B"] == (5, 1, 0, 2) and pairs["C", "A"] == (3, 2, 3, 0)
    assert {tuple(r) for r in patterns.md_pattern(general).collect()} == {(1, 1, 1, 2, 0), (1, 1, 0, 3, 1), (1, 0, 1, 1, 1), (0, 0, 1, 2, 2)}
    flux = {r["column"]: (r.pobs, r.influx, r.outflux) for r in patterns.flux(general).collect()}
    assert flux == {"A": (0.75, 0.125, 0.5), "B": (0.625, 0.25, 0.375), "C": (0.625, 0.375, 0.625)}


def test_temporal(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 20.0, None, 30.0, 40.0, None])], "t long, v double")
    got = lambda d: [r.v for r in d.orderBy("t").collect()]
    assert got(temporal.interpolate(df, "v", ["t"])) == [20, 20, 25, 30, 40, 40]
    assert got(temporal.locf(df, "v", ["t"])) == [20, 20, 20, 30, 40, 40]
    assert got(temporal.nocb(df, "v", ["t"])) == [20, 20, 30, 30, 40, 40]
    for m in ("quadratic", "cubic", "barycentric"):
        x = spark.createDataFrame([(i, None if i == 4 else float(i * i)) for i in range(9)], "t long, v double")
        assert abs(got(temporal.interpolate(x, "v", ["t"], method=m))[4] - 16) < 1e-6


def test_checks(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b string")
    with pytest.raises(ValueError):
        checks.check_nan_columns(df)
    with pytest.raises(TypeError):
        checks.check_frame([1])
    with pytest.raises(ValueError):
        checks.strategies("nope", ["a"], ["mean"])
    with pytest.raises(TypeError):
        SingleImputer({"s": "mean"}).fit(spark.createDataFrame([("x",), (None,)], "s string"))


def test_pmm_values_are_donors(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") * 2.0).alias("y"))
    out = regression.fill(df, "y", "pmm", ["x"], ["id"], 1)
    rows = {r.id: r.y for r in out.collect()}
    assert len(rows) == 400 and all(y is not None and y % 2 == 0 for y in rows.values())
    assert all(abs(y - 2 * i) <= 20 for i, y in rows.items())


def test_rubin():
    import numpy as np

    r = pooling.rubin(np.array([[1.0], [3.0]]), np.array([[1.0], [2.0]]))
    assert r["coefs"][0] == 2 and r["vw"][0] == 1.5 and r["vb"][0] == 2 and r["vt"][0] == 4.5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        _same(rows, [tuple(float(x) if hasattr(x, "as_tuple") else x for x in (r[i] for i in order)) for r in cur.fetchall()])


def test_neighbours_and_fill_values(spark):
    rows = [(i, float(i), float(i * i)) for i in range(20)] + [(20, 9.5, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    cell = lambda **kw: regression.fill(df, "y", kw.pop("how"), ["x"], ["id"], 1, **kw).where("id = 20").first().y
    assert cell(how="pmm", neighbors=1) in {r[2] for r in rows}
    near = cell(how="pmm", neighbors=20, fill_value="mean")
    assert near == pytest.approx(sum(r[2] for r in rows[:20]) / 20)
    mean = cell(how="bayesian least squares")
    assert mean == pytest.approx(cell(how="least squares")) and mean != cell(how="bayesian least squares", fill_value="random")
    with pytest.raises(ValueError):
        cell(how="pmm", fill_value="mode")


def test_mice_keeps_rows_without_keys(spark):
    from lacuna.operators.imputers import MiceImputer

    rows = [(None if i % 3 else i, float(i % 7), None if i % 4 == 0 else 2.0 * (i % 7) + 1) for i in range(60)] + [(0, 1.0, None)] * 2
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = MiceImputer(k=2, n=2, strategy={"y": "least squares"}, key=["id"]).fit_transform(df).collect()
    assert len(out) == 2 * len(rows) and all(abs(r.y - 2 * r.x - 1) < 1e-6 for r in out)
    bare = MiceImputer(k=2, n=1, strategy={"y": "stochastic"}).fit_transform(df.drop("id"))
    assert bare.count() == len(rows) and bare.where("y IS NULL").count() == 0
