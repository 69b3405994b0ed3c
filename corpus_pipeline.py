"""The corpus pipeline: toxicity, near-dedup, decontamination, PII, mixing.

Each stage takes any table with the columns doc_id and text (mixing also lang
and source) and returns its columns, whatever their names; the last adds
n_tokens, copies and leaf_budget.

Cases: null and empty texts are scored like any text, are in no group of copies
and hold no benchmark words, so they reach the last stage, which gives them the
place of texts without tokens. Rows with a null id are kept by the filters of
whole texts; a repeated id stays if its document does. An empty table gives an
empty one. Ties between copies go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, mixing, near_dedup, pii, toxicity
from lacuna.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays; texts without words are in no group."""
    kept = near_dedup.near_components(docs, width=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of test windows are cut out; a document of nothing else goes."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    cells = [F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.where((hit == 0) | (hit < F.col("n_words"))).select(*cells)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.tree(), 0.5, seed=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("pii", replace_pii),
    ("mixing", mix_sources),
]
#: The label model, the FM-index and the chosen-path join have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
