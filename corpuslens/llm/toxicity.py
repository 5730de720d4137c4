"""Toxicity scores by logistic regression trained with FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow, mix, read

#: Hashed features: 1 to 2 ** BITS. Index 0 is the intercept.
BITS = 22
#: FTRL-proximal: rate ALPHA, BETA, penalties L1 and L2, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 2.5, 0.05, 6
#: Labelled rows learnt from at most, of label 1 and of label 0, those of least hash: the sample is bounded, scores are for all.
MOST_TOXIC, MOST_CLEAN = 6000, 10_000
#: Rows whose crc32 of doc_id modulo FOLDS is 0 are held out.
FOLDS = 5

_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """Feature indices of a text, repeats included: its words, neighbouring pairs and pairs with one word between."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    turned = mix(h + np.uint64(1))
    grams = np.concatenate([h, mix(turned[:-1] + h[1:]), mix(turned[:-2] ^ (h[2:] + np.uint64(7)))]) if len(h) else h
    return (grams & np.uint64((1 << BITS) - 1)).astype(np.int64) + 1


def train(examples: list[tuple[np.ndarray, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) that aren't zero, of examples (indices, label, weight), in a fixed order over PASSES passes."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    total = sum(w for _, _, w in examples)
    base = sum(w * y for _, y, w in examples) / total if total else 0.0
    start = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    order = np.random.default_rng(5)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(PASSES):
        for k in order.permutation(len(examples)):
            at, y, weight = examples[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + start, -30, 30)))
            g = weight * (p - y)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    found = np.flatnonzero(np.abs(z) > L1)
    return np.concatenate([[0], found]), np.concatenate([[start], weights(found)])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sampled texts, where these are read: the one task that learns gets numbers."""
    for batch in batches:
        made = [np.unique(features(text)).astype("<i4").tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["doc_id", "features", "toxic"])


def _learn(weight: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda x: (x[0], len(x[1]), x[1]))
        if rows:
            at, w = train([(np.frombuffer(f, "<i4"), int(label), weight[int(label)]) for _, f, label in rows])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["feature", "weight"])

    return run


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels that aren't held out: one row per doc_id (1 if any says so)."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def class_weights(labels: DataFrame) -> dict[int, float]:
    """The weight of a sampled row by label: labels of its class by those sampled, 1 in the mean; thus the base rate is that of all labels, whichever class is capped."""
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in usable(labels).groupBy("toxic").count().collect()}
    taken = {0: min(n[0], MOST_CLEAN), 1: min(n[1], MOST_TOXIC)}
    mean = sum(n.values()) / max(1, sum(taken.values()))
    return {y: n[y] / taken[y] / mean if taken[y] else 1.0 for y in n}


def sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from: usable labels, at most MOST_TOXIC and MOST_CLEAN rows."""
    one = usable(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda y, n: one.where(F.col("toxic") == y).orderBy(*order).limit(n)
    return pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from labelled rows of docs; (empty, empty) without any. The sample is bounded, and so is what comes back."""
    picked = sample(labels).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("text").cast("string"), "toxic")
    featured = map_arrow(rows, _featured, "doc_id long, features binary, toxic int")
    found = map_arrow(featured.repartition(1), _learn(class_weights(labels)), "feature long, weight double").toArrow()
    return found["feature"].to_numpy(), found["weight"].to_numpy()


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """Text -> log odds of label 1 (the intercept for an empty text; without a model a low value)."""
    at, w = model
    start = float(w[0]) if len(w) else -30.0
    dense = np.zeros((1 << BITS) + 1, np.float32)
    if len(w):
        dense[at[1:]] = w[1:]

    def log_odds(text: str | None) -> float:
        f = features(text)
        return start + float(dense[np.unique(f[dense[f] != 0])].sum())

    return log_odds


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) for each row of docs, from whole texts. L1 leaves few weights, which are broadcast; there are at most 2 ** BITS."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_odds = scorer(sent.value)
        for batch in batches:
            odds = np.array([log_odds(x) for x in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored, and so are labels without doc_id
    or toxic. Null and empty texts get the intercept's score. Without labelled rows every score is near 0. A row without doc_id
    is scored and counts as not held out. Repeated rows are scored each; an empty table gives no rows.
    """
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose score is below 0.5, with all columns, whatever their names; texts are scored as rows pass, so nothing is joined.

    Null and empty texts get the intercept's score and so stay, unless most labels are toxic. Rows without doc_id and repeated rows are scored each; without
    labelled rows all stay; an empty table gives no rows.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_odds = scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([log_odds(x) < 0 for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
