"""Shared tables, words and distributed running sums used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as a regular expression class, in the form Java and DuckDB both read.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on one
    machine, as in tests, a temporary folder is set once for the session.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracksmith-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracksmith/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts the lineage without executor-local copies, so a lost executor loses nothing.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`materialize` wrote and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of at most ``rows`` rows.

    Spark's own 10,000 whole texts are held at once by a task in the executor and again in its
    worker, which keeps that memory for all later tasks. Results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8; null has none.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is exactly this definition.
    """
    return text.encode("utf-8").lower().split() if text else []


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def running_total(df: DataFrame, group: str, key: list[str], size: str, out: str, rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the earlier rows of the same group.

    Rows of a group are ordered by a hash bucket of ``key`` and then by ``key``. Totals of the
    buckets are summed first, so that no task ever holds a whole group: a group with a third
    of all rows is spread over as many tasks as it has buckets. ``group`` must not be null.
    ``df`` is read three times and should be a written table.
    """
    buckets = max(1, -(-df.count() // rows_a_bucket))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    offsets = totals.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(offsets, [group, "_bucket"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_bucket", "_before")
    )
