"""All queries of the engine by name, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators import scalar
from tracksmith.plans import clip_queries, pose_queries, report_queries, storage_queries, track_queries
from tracksmith.sources import views

QUERIES = {**track_queries.QUERIES, **pose_queries.QUERIES, **report_queries.QUERIES, **storage_queries.QUERIES, **clip_queries.QUERIES}
ORACLE_SQL = {**track_queries.ORACLE_SQL, **pose_queries.ORACLE_SQL, **report_queries.ORACLE_SQL, **storage_queries.ORACLE_SQL, **clip_queries.ORACLE_SQL}


def rates_and_worst_errors(spark: SparkSession, sf_dir: str, precision: float = 1e-3) -> DataFrame:
    """(clip_id, bits_per_frame, track_index, error, time): what the scalar pipeline chooses and what it costs."""
    tracks = views.embedding_tracks(spark, sf_dir)
    rates = scalar.bit_rates(tracks, precision)
    worst = scalar.worst_error(scalar.errors(scalar.quantize(tracks, rates)), views.RATE)
    return rates.groupBy("clip_id").agg(F.sum("bit_rate").alias("bits_per_frame")).join(worst, "clip_id")
