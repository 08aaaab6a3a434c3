"""A quality classifier on supervised subword embeddings.

Words, word pairs and character n-grams are hashed to buckets; each bucket has a learned
vector, a text is the mean of its buckets' vectors, and a softmax over a linear layer gives the
label. Training is plain stochastic gradient descent in numpy in one task, on a bounded
sample of labelled rows; the driver only gets the finished model, one number a bucket. As the output is linear in the mean, a trained model is one number a
bucket: scoring is a table look-up per n-gram of the whole text, without a shuffle.

Defined cases: a null or empty text has no n-grams and scores the class prior; a row with a
null doc_id is scored and counts as the id '' for the fold; without labelled rows of two
classes every score is the prior; repeated labels of one id count once, by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracksmith.llm.common import crc_mod

BUCKETS, DIM = 1 << 16, 8
#: The bound of the training sample: rows, and characters of a row that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 100_000
GRAMS = (2, 3, 4)
THRESHOLD = 0.3
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MIX
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def features(text: str | None) -> np.ndarray:
    """The bucket of every word, word pair and character n-gram; a pair of equal words is one token of its own."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer((" " + text + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(space, np.uint64(32), code)
    code = code[~(space & np.append(False, space[:-1]))]  # one space for a run
    out = []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(code) - n + 1] * _PRIME + code[n - 1 :]
        if not len(h):
            break
        if n in GRAMS:
            out.append(_buckets(h, n))
    gaps = np.flatnonzero(code == 32)
    if len(gaps) > 1:
        start, length = gaps[:-1] + 1, np.diff(gaps) - 1
        power = np.ones(int(length.max()) + 1, dtype=np.uint64)
        np.cumprod(np.full(len(power) - 1, _PRIME), out=power[1:])
        body = code[: gaps[-1]].copy()
        body[gaps[:-1]] = 0
        place = np.arange(len(body)) - np.repeat(gaps[:-1], np.diff(gaps))
        word = np.add.reduceat(body * power[place], start)
        out.append(_buckets(word, 101))
        if len(word) > 1:
            pair = np.where(word[:-1] == word[1:], np.uint64(1), word[:-1] * _PRIME + word[1:])
            out.append(_buckets(pair, 102))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def train(texts: list[str | None], labels: list[int], epochs: int = 12, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, float]:
    """The logit of label 1 that a bucket adds, and the bias."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(BUCKETS, dtype=np.float64), float(np.log(p / (1 - p)))
    rows = []
    for text in texts:
        bucket, count = np.unique(features(text), return_counts=True)
        rows.append((bucket.astype(np.int32), (count / max(count.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), dtype=np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, weight = rows[i]
            hidden = weight @ vectors[bucket] if len(bucket) else np.zeros(DIM, dtype=np.float32)
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y[i]] -= 1
            now = rate * (1 - step / steps)
            push = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= 0.02 * now * error
            if len(bucket):
                vectors[bucket] -= (now * 50) * weight[:, None] * push
            step += 1
    logit = vectors.astype(np.float64) @ layer.astype(np.float64)
    return logit[:, 1] - logit[:, 0], float(bias[1] - bias[0])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, text, y): at most ``rows`` labelled texts of the learning folds, picked by a hash of the id."""
    picked = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod("doc_id", 5) != 0)
        .groupBy("doc_id").agg(F.avg("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    picked = picked.select(F.col("doc_id").alias("_id"), (F.col("_q") >= 0.5).cast("int").alias("_y"))
    docs = docs.select("doc_id", "text")
    found = docs.join(F.broadcast(picked), docs.doc_id == picked._id).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("_y").alias("y")).withColumnRenamed("_id", "id")


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on ``sample`` (id, text, y) in one task, in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("y").to_pylist()
        logit, bias = train(texts, labels)
        yield pa.RecordBatch.from_arrays([pa.array([logit.tobytes()]), pa.array([bias])], ["logit", "bias"])

    model = sample.repartition(1).sortWithinPartitions("id").mapInArrow(run, "logit binary, bias double").first()
    return (np.frombuffer(model["logit"]), model["bias"]) if model else train([], [])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the chance of label 1 by the whole text."""
    logit, bias = model
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for i, value in enumerate(batch.column(at)):
                buckets = features(value.as_py())
                if len(buckets):
                    out[i] += logit[buckets].mean()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-out)))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    return fit(training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(docs, quality_model(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
