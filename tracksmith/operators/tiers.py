"""Databases of quality tiers: which frames move to which tier, chunks, stripping, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.model import DatabaseSettings
from tracksmith.operators import buckets

TIERS = ("high", "medium", "low")
CHUNKS = "tier string, clip_id long, segment_index int, bytes long, chunk int, offset long"
HEADER, PADDING = 16, 15


class TierError(ValueError):
    """A tier cannot be stripped."""


def assign_tiers(ranked: DataFrame, settings: DatabaseSettings) -> DataFrame:
    """Adds tier to ranked frames (clip_id, segment_index, sample_index, position, error, movable).

    Over all clips the frame of least error goes first, a clip's frames in their own order; the
    low tier takes its share of all frames, then the medium one, both from movable frames only.
    The order is found in buckets of the error; a frequent error is a bucket of its own a clip. Ranks
    are the counts of the buckets before and the place inside, so no task orders all frames.
    """
    settings.validate()
    error = F.col("error")
    total, movable, found = ranked.agg(F.count("*"), F.count_if("movable"), buckets.points(F.when(F.col("movable"), error))).first()
    bounds, often = buckets.bounds(found, movable)
    low = min(movable, int(settings.low_importance_tier_proportion * total))
    medium = min(movable - low, int(settings.medium_importance_tier_proportion * total))
    parts = ranked.where("movable").withColumns({"_part": buckets.part(error, bounds, often), "_clip": F.when(buckets.is_often(error, often), F.col("clip_id")).otherwise(0)})
    local = Window.partitionBy("_part", "_clip").orderBy("error", "clip_id", F.desc("segment_index"), "position")
    parts = parts.withColumn("_local", F.row_number().over(local))
    counts = parts.groupBy("_part", "_clip").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part", "_clip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_clip", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = parts.join(F.broadcast(offsets), ["_part", "_clip"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    tier = F.when(F.col("_rank") <= low, "low").when(F.col("_rank") <= low + medium, "medium").otherwise("high")
    keep = [*ranked.columns, "tier"]
    return placed.withColumn("tier", tier).select(*keep).union(ranked.where("NOT movable").withColumn("tier", F.lit("high")).select(*keep))


def sample_masks(assigned: DataFrame, starts: DataFrame) -> DataFrame:
    """(clip_id, segment_index, tier, mask): frames of a segment in a tier as bits from the highest of 32."""
    met = assigned.join(starts.select("clip_id", "segment_index", "start"), ["clip_id", "segment_index"])
    bit = F.pow(F.lit(2.0), 31 - (F.col("sample_index") - F.col("start"))).cast("long")
    return met.groupBy("clip_id", "segment_index", "tier").agg(F.sum(bit).alias("mask"))


def chunk_layout(sizes: DataFrame, max_chunk_size: int) -> DataFrame:
    """Places (tier, clip_id, segment_index, bytes) first-fit in (clip, segment) order into chunks.

    Filling is sequential within a tier of one database; rows here are segments, not samples.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["clip_id", "segment_index"])
        chunk, used, chunks, offsets = 0, HEADER, [], []
        for n in pdf["bytes"]:
            if used > HEADER and used + n + PADDING + HEADER >= max_chunk_size:
                chunk, used = chunk + 1, HEADER
            chunks.append(chunk)
            offsets.append(used)
            used += int(n) + HEADER
        return pdf.assign(chunk=chunks, offset=offsets)[["tier", "clip_id", "segment_index", "bytes", "chunk", "offset"]]

    return sizes.groupBy("tier").applyInPandas(fill, CHUNKS)


def strip_tier(frames: DataFrame, tier: str) -> DataFrame:
    """Drops a tier's frames; on a table partitioned by tier this reads nothing of it."""
    if tier not in TIERS[1:]:
        raise TierError("only the medium and low tiers can be stripped")
    return frames.where(F.col("tier") != tier)


def write_database(frames: DataFrame, path: str) -> None:
    """Bulk data in a folder a tier and chunk, so tiers can be moved and dropped apart."""
    frames.write.partitionBy("tier").parquet(path)


def database_stats(chunks: DataFrame) -> DataFrame:
    """(tier, num_chunks, num_clips, num_segments, total_bytes)."""
    return chunks.groupBy("tier").agg(
        F.count_distinct("chunk").alias("num_chunks"), F.count_distinct("clip_id").alias("num_clips"), F.count("*").alias("num_segments"), F.sum("bytes").cast("long").alias("total_bytes")
    )


def contains(database: DataFrame, clips: DataFrame) -> DataFrame:
    """The clips whose hash the database holds."""
    return clips.join(database.select("clip_hash"), "clip_hash", "left_semi")


def clip_hashes(samples: DataFrame) -> DataFrame:
    """(clip_id, clip_hash): order-free over a clip's samples, equal for equal content."""
    one = F.xxhash64(*[c for c in samples.columns if c != "clip_id"]).cast("decimal(20,0)")
    return samples.groupBy("clip_id").agg(F.xxhash64(F.sum(one), F.count("*")).alias("clip_hash"))
