"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and sorted by digest,
so that the anti-join with new data is a sort-merge join that shuffles only the new digests.
Only digests, ids and lengths are shuffled, never texts. Equal digests are counted before
they are exchanged, so a text with a third of all rows costs one row per task.

Every digest carries the name of the batch that brought it. A batch that is run again, after a
failure or on purpose, finds its own digests, adds nothing and gives the same rows. Batches
that run at the same time must not share texts.

Defined cases: null text counts as empty; empty and all-space texts are one group; of rows
that tie on length the smallest doc_id stays, a null doc_id after all others; rows repeated
with the same doc_id are all kept if that doc_id stays, since nothing tells them apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import discard, materialize

#: The characters that normalisation deletes: [\x20\x09-\x0D].
DELETED = " \t\n\x0b\x0c\r"
#: Digests of a bucket, about 100 MB.
BUCKET_ROWS = 2_000_000


def digest_column() -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), DELETED, ""), 256))


def digests(docs: DataFrame) -> DataFrame:
    length = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_points"), digest_column().alias("digest"))


class DigestIndex:
    """A bucketed, sorted table ``name`` of (digest, keep_id, batch), created empty if missing.

    ``buckets`` is fixed when the table is created; :func:`buckets_for` gives it for the number
    of digests that the index is to hold.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 8):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _write(self, rows: DataFrame, mode: str, name: str) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).saveAsTable(name)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self._write(self.spark.createDataFrame([], "digest binary, keep_id long, batch string"), "ignore", self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds rows; one task writes each bucket, so an append makes one file a bucket."""
        named = rows.select("digest", "keep_id", F.lit(batch).alias("batch"))
        self._write(named.repartition(self.buckets, "digest"), "append", self.name)

    def compact(self) -> None:
        """Rewrites the table with one sorted file a bucket, as before the first append."""
        fresh = f"{self.name}_{uuid.uuid4().hex}"
        # the scan claims to be dealt by digest already; by an expression of it rows are exchanged all the same
        self._write(self.read().repartition(self.buckets, F.coalesce("digest", F.lit(b""))), "error", fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(digests: int) -> int:
    return max(1, -(-digests // BUCKET_ROWS))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """A written table of one row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    ``known`` says that an earlier batch already holds the text; then keep_id is that batch's
    row. Digests that the index lacks are appended to it under the name ``batch``.
    """
    rows = materialize(digests(docs), "digests")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id"))
    groups = materialize(rows.groupBy("digest").agg(best["doc_id"].alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.append(groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti"), batch)
    found = index.read().select("digest", "keep_id", (F.col("batch") != batch).alias("known"))
    decided = materialize(groups.select("digest", "group_size").join(found.hint("merge"), "digest"), "decided")
    out = materialize(
        rows.join(decided.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "known",
        ),
        "deduplicated",
    )
    for table in (rows, groups, decided):
        discard(table)
    return out


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` as the first batch of a new index, which goes again afterwards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets_for(docs.count()))
    try:
        return deduplicate(docs, index, "documents")
    finally:
        index.drop()


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, false AS known FROM g
"""
