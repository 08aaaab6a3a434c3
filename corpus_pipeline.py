"""A corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``docs``. Columns beyond those of documents are carried along
whatever their names are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.llm.common import materialize, small_batches
from tracksmith.llm.exact import DigestIndex, buckets_for, deduplicate, digest_column
from tracksmith.llm.mixing import mix_documents
from tracksmith.llm.packing import TOKENIZER, pack_documents
from tracksmith.llm.quality import THRESHOLD, quality_model, score_documents
from tracksmith.llm.simhash import near_duplicates


def spare_name(df: DataFrame, name: str) -> str:
    """``name`` or a longer one that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = spare_name(docs, "score")
    return score_documents(docs, quality_model(spark, docs, sf_dir), name=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, match: Column) -> DataFrame:
    """The rows of ``docs`` that match none of ``gone``, a written table of at most 100 bytes a row.

    ``gone`` is sent to the executors only below 64 MB; beyond that both sides are exchanged.
    """
    few = gone.count() <= (64 << 20) // 100
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), match, "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text stays: the longest original, then the smallest doc_id."""
    index = DigestIndex(spark, f"pipeline_index_{uuid.uuid4().hex}", buckets_for(docs.count()))
    decided = deduplicate(docs, index, "documents")
    index.drop()
    gone = materialize(decided.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).distinct(), "gone")
    digest = spare_name(docs, "digest")
    own = docs.withColumn(digest, digest_column())
    left = without(own, gone, own["doc_id"].eqNullSafe(gone["_id"]) & (own[digest] == gone["_digest"]))
    if not decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        # rows repeated with one doc_id: the longest of each text stays
        order = Window.partitionBy("doc_id", digest).orderBy(F.length("text").desc())
        rank = spare_name(left, "rank")
        left = left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 on five-word shingles stays: the smallest doc_id."""
    with small_batches(spark):
        gone = materialize(near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")), "gone")
    return without(docs, gone, docs["doc_id"] == gone["_id"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the text of the words taken."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    Workers also hold what earlier stages left, so they remember fewer words than for packing alone.
    """
    import public_tokenizers

    with small_batches(spark):
        return pack_documents(docs, public_tokenizers.path(TOKENIZER), memory=250_000)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
