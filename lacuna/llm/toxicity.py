"""Toxicity by weak supervision.

1. A lexicon of words and of word beginnings is mined from labelled rows: terms
   far likelier in toxic texts. Counts are summed within each block first.
2. Voters are groups of lexicon terms (by kind and hash), which vote toxic when
   a text has one of theirs, and one for each kind that votes clean when a text
   has none of the kind.
3. A generative model of the votes (one hidden label) is fitted by expectation
   maximisation; correlations of voters that the label doesn't explain shrink
   their votes, so that echoes of a voter don't count twice.
4. A logistic regression on the voters' counts is trained on the posterior
   labels and scores every whole text by a Column.

Labels come from a sample of at most ``sample`` labelled rows, in the order of
a hash of their ids; the lexicon has at most ``terms`` terms of each kind. These
bound the model; every row is scored.

Cases: null and empty texts have no terms and get the score of such texts;
without labels of both classes every score is 0; repeated rows and null ids keep
a row each; an empty table gives an empty result; columns that clash with the
results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

SAMPLE, TERMS, BUCKETS = 20_000, 1000, 8
THRESHOLD = 0.3
#: 0 is the whole word, others the letters of its beginning.
KINDS = (0, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[tuple[int, str]]:
    found = set(_WORD.findall(text.lower()))
    return {(0, w) for w in found} | {(k, w[:k]) for k in KINDS[1:] for w in found if len(w) >= k}


@dataclass(frozen=True)
class Model:
    lexicon: dict[tuple[int, str], int]
    weights: tuple[float, ...]
    intercept: float
    accuracies: tuple[float, ...] = ()

    def score(self, counts: Column) -> Column:
        total = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            total = total + F.lit(float(w)) * F.log1p(counts[i].cast("double"))
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def emit() -> pa.RecordBatch:
        rows = list(count.items())
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int32()), pa.array([r[0][1] for r in rows], pa.string()), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["kind", "term", "toxic", "n"])

    for batch in blocks(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            count.update((k, t, toxic) for k, t in terms_of(text))
        if len(count) > 200_000:
            yield emit()
    yield emit()


def _counts(lexicon: dict[tuple[int, str], int], width: int):
    words = {}
    for (k, t), v in lexicon.items():
        words.setdefault(k, {})[t] = v

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                row = [0] * width
                for w in set(_WORD.findall(text.lower())):
                    for k, known in words.items():
                        v = known.get(w[:k] if k else w)
                        if v is not None and len(w) >= k:
                            row[v] += 1
                out.append(row)
            yield pd.Series(out)

    return F.pandas_udf(run, "array<int>")


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """votes: 1 toxic, -1 clean, 0 none. Posterior of toxic, and each voter's accuracy; ``start`` is a first posterior."""
    post = start.copy()
    active = votes != 0
    keep = np.ones(votes.shape[1])
    for r in range(rounds):
        likely = np.zeros((2, len(votes)))
        for c, w in ((1, post), (0, 1 - post)):
            for v in (1, -1, 0):
                p = (((votes == v) * w[:, None]).sum(axis=0) + 0.5) / (w.sum() + 1.5)
                likely[c] += ((votes == v) * (np.log(p) * keep)).sum(axis=1)
        gap = likely[1] - likely[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
        if r in (0, 5):
            # what remains of votes once the label is known: shared errors
            mean = lambda w: (votes * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)  # noqa: B023, E731
            rest = votes - np.outer(new, mean(new)) - np.outer(1 - new, mean(1 - new))
            sd = np.maximum(rest.std(axis=0), 1e-6)
            corr = (rest.T @ rest) / len(votes) / np.outer(sd, sd)
            keep = 1 / (np.maximum(np.abs(corr) - 0.1, 0).sum(axis=1) + 0.1)
            keep = np.minimum(keep, 1.0)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done and r > 5:
            break
    right = np.where(votes == 1, post[:, None], 1 - post[:, None]) * active
    return post, right.sum(axis=0) / np.maximum(active.sum(axis=0), 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    from pyspark.ml.classification import LogisticRegression

    spark = docs.sparkSession
    none = Model({}, (), -40.0)
    fold = F.crc32(F.col(id_col).cast("string"))
    chosen = labels.where(f"{id_col} IS NOT NULL AND {label_col} IN (0, 1)").where(fold % 4 != 2).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select("text", "toxic")  # at most ``sample`` ids
    base = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = base.get(1, 0), base.get(0, 0)
    if not n1 or not n0:
        return none
    counted = rows.mapInArrow(_mine, "kind int, term string, toxic int, n long").groupBy("kind", "term").agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    least = max(3, n1 // 200)
    strong = counted.where(F.col("pos") >= least).withColumn("odds", odds).where("odds > 2.5")
    lexicon, kinds = {}, []
    for i, k in enumerate(KINDS):
        top = strong.where(F.col("kind") == k).orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "term").limit(terms).collect()
        if top:
            kinds.append(i)
        for r in top:
            lexicon[k, r.term] = i * BUCKETS + xxhash.xxh32_intdigest(r.term) % BUCKETS
    if not lexicon:
        return none
    width = len(KINDS) * BUCKETS
    got = rows.select("toxic", _counts(lexicon, width)("text").alias("c")).toPandas()  # at most ``sample`` short rows
    counts, truth = np.array(got.c.tolist(), float), got.toxic.to_numpy(float)
    clean = -(counts.reshape(len(counts), len(KINDS), BUCKETS).sum(axis=2) == 0).astype(float)[:, kinds]
    votes = np.hstack([(counts > 0).astype(float), clean])
    post, accuracy = label_model(votes, n1 / (n1 + n0), 0.05 + 0.9 * truth)
    from pyspark.ml.linalg import Vectors

    both = [(Vectors.dense(np.log1p(c)), y, float(w)) for c, p in zip(counts, post) for y, w in ((1.0, p), (0.0, 1 - p)) if w > 1e-6]
    train = spark.createDataFrame(both, ["features", "label", "weight"])
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, standardization=False, maxIter=50).fit(train)
    return Model(lexicon, tuple(fitted.coefficients.toArray()), float(fitted.intercept), tuple(accuracy))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1."""
    if not model.lexicon:
        return docs.withColumn("score", F.lit(0.0))
    width = len(KINDS) * BUCKETS
    counts = _counts(model.lexicon, width)(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumn("score", counts).withColumn("score", model.score(F.col("score")))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
