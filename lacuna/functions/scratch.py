"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder serves a session on one machine, and on a cluster that is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lacuna.scratch.dir", None)
    if not own:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("lacuna.scratch.dir", own)
    return own.rstrip("/")


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path: plans don't grow, and lost executors cost no more than the step."""
    path = f"{shared_dir(df.sparkSession)}/lacuna-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
