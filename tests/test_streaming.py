"""LOCF across micro-batches against the batch operator."""

import os

from pyspark.sql import functions as F

from lacuna.operators import temporal
from lacuna.sources.masked import masked
from lacuna.streaming.locf import locf

DATA = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, batches, **kw):
    source = tmp_path / "in"
    os.makedirs(source)
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next(f for f in os.listdir(tmp_path / f"b{i}") if f.startswith("part"))
        os.rename(tmp_path / f"b{i}" / part, source / f"{i}.parquet")
        os.utime(source / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = locf(stream, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= len(batches)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    df = masked(spark, DATA, "events", "user_id", "ts").select("event_id", "user_id", "ts", "value").where("user_id < 15").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).drop("ts").cache()
    low, high = df.agg(F.min("at"), F.max("at")).first()
    cut = [low + (high - low) * i // 4 for i in range(5)]
    parts = [df.where((F.col("at") >= a) & (F.col("at") < b + (b == high))) for a, b in zip(cut[:-1], cut[1:])]
    got = {r.event_id: r.value for r in streamed(spark, tmp_path, parts, column="value", key="user_id", order="at").collect()}
    want = temporal.locf(df, "value", ["at"], ["user_id"]).collect()
    first = {r.user_id: r["min(at)"] for r in df.where("value IS NOT NULL").groupBy("user_id").agg(F.min("at")).collect()}
    assert len(got) == len(want) == df.count()
    assert all(got[r.event_id] == (r.value if r.user_id in first and r["at"] >= first[r.user_id] else None) for r in want)


def test_late_rows_and_starts(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, t long, v double")
    batches = [make([("a", 1, None), ("a", 2, 5.0), (None, 1, 7.0)]), make([("a", 3, float("nan")), ("a", 1, None), (None, 2, None)]), make([("a", 4, None), ("b", 1, None), ("a", 2, 9.0)])]
    got = sorted((str(r.k), r.t, r.v) for r in streamed(spark, tmp_path, batches, column="v", key="k", order="t", start=-1.0).collect())
    assert got == [("None", 1, 7.0), ("None", 2, 7.0), ("a", 1, -1.0), ("a", 1, -1.0), ("a", 2, 5.0), ("a", 2, 9.0), ("a", 3, 5.0), ("a", 4, 9.0), ("b", 1, -1.0)]
