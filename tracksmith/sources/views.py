"""Track views over relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATE = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, sample_index, frame): one row a sample with all 64 numbers as DOUBLE; a clip is a label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("clip_id"),
        (F.row_number().over(order) - 1).alias("sample_index"),
        F.col("embedding").cast("array<double>").alias("frame"),
    )


def embedding_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 float tracks a clip: (clip_id, track_index, sample_index, v)."""
    return embedding_frames(spark, sf_dir).select("clip_id", F.posexplode("frame").alias("track_index", "v"), "sample_index")


def embedding_vectors(spark: SparkSession, sf_dir: str, width: int = 4) -> DataFrame:
    """Tracks of ``width`` components: (clip_id, track_index, sample_index, v array)."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(64 // width - 1)), lambda i: F.slice("frame", i * width + 1, width))
    return embedding_frames(spark, sf_dir).select("clip_id", F.posexplode(slices).alias("track_index", "v"), "sample_index")


def embedding_poses(spark: SparkSession, sf_dir: str, bones: int = 6) -> DataFrame:
    """Poses of 6 bones of 10 numbers: (clip_id, sample_index, bone, parent, q, t, s).

    Rotations are normalised numbers, translations numbers x 100, scales 1 + a tenth of them;
    the parent of bone b > 0 is (b - 1) div 2.
    """
    at = lambda b, i: F.element_at("frame", b * 10 + i + 1)
    length = lambda b: F.sqrt(at(b, 0) * at(b, 0) + at(b, 1) * at(b, 1) + at(b, 2) * at(b, 2) + at(b, 3) * at(b, 3))
    rows = embedding_frames(spark, sf_dir).select("clip_id", "sample_index", "frame", F.explode(F.sequence(F.lit(0), F.lit(bones - 1))).alias("bone"))
    b, n = F.col("bone"), F.col("n")
    return rows.withColumn("n", length(b)).select(
        "clip_id",
        "sample_index",
        "bone",
        F.when(b > 0, F.floor((b - 1) / 2).cast("int")).alias("parent"),
        F.when(n < 1e-9, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(*[at(b, i) / F.when(n < 1e-9, 1.0).otherwise(n) for i in range(4)])).alias("q"),
        F.array(*[at(b, i) * 100.0 for i in (4, 5, 6)]).alias("t"),
        F.array(*[1.0 + 0.1 * at(b, i) for i in (7, 8, 9)]).alias("s"),
    )


def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a user with a sample a day of January, gaps and all: (clip_id, track_index, sample_index, v)."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("long").alias("clip_id"), (F.dayofmonth("ts") - 1).alias("sample_index"))
        .agg(F.avg("value").alias("v"))
        .select("clip_id", F.lit(0).alias("track_index"), "sample_index", "v")
    )


def price_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tracks of monthly means a (returnflag, linestatus) clip: (clip_id, track_index, sample_index, v)."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", month).agg(*[F.avg(c).alias(c) for c in names])
    clip = F.dense_rank().over(Window.orderBy("l_returnflag", "l_linestatus")) - 1
    sample = F.row_number().over(Window.partitionBy("l_returnflag", "l_linestatus").orderBy("m")) - 1
    rows = rows.select(clip.cast("long").alias("clip_id"), sample.alias("sample_index"), F.array(*names).alias("frame"))
    return rows.select("clip_id", F.posexplode("frame").alias("track_index", "v"), "sample_index")
