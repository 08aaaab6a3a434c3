"""Segments: splitting, padded 8-bit ranges and two-level range reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.functions import timeline as tl
from tracksmith.operators.scalar import KEY, normalize, normalized_value

STEPS = 255.0


def segment_table(clips: DataFrame) -> DataFrame:
    """(clip_id, segment_index, start, size) of clips (clip_id, num_samples)."""
    sizes = tl.segment_sizes(F.col("num_samples"))
    rows = clips.select("clip_id", sizes.alias("sizes")).select("clip_id", F.posexplode("sizes").alias("segment_index", "size"), "sizes")
    start = F.aggregate(F.slice("sizes", 1, F.col("segment_index")), F.lit(0), lambda a, x: a + x)
    return rows.select("clip_id", "segment_index", start.alias("start"), "size")


def with_segments(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """Adds segment_index and segment_start to samples, by arithmetic on the sample's index."""
    n = F.col("_n")
    k = F.when(n <= 31, 1).when(n == 32, 2).otherwise(F.ceil(n / 16) - 1).cast("int")
    small, extra, i = F.floor(n / k).cast("int"), n % k, F.col("sample_index")
    wide = extra * (small + 1)
    index = F.when(i < wide, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - wide) / small)).cast("int")
    start = F.when(F.col("segment_index") < extra, F.col("segment_index") * (small + 1)).otherwise(wide + (F.col("segment_index") - extra) * small)
    met = samples.join(clips.select("clip_id", F.col("num_samples").alias("_n")), "clip_id")
    return met.withColumn("segment_index", index).withColumn("segment_start", start.cast("int")).drop("_n")


def padded_range(low: Column, high: Column) -> tuple[Column, Column]:
    """(min, extent) on a grid of 1/255 that still covers [low, high].

    The minimum is floored and the extent ceiled; the extent gets one more step where it does
    not reach the range's maximum.
    """
    start = F.greatest(F.lit(0.0), F.floor(low * STEPS) / STEPS)
    extent = F.ceil((high - start) * STEPS) / STEPS
    wide = F.when(extent < high, F.least(F.lit(1.0), extent + 1.0 / STEPS)).otherwise(extent)
    return start, wide


def segment_ranges(samples: DataFrame, clips: DataFrame, precision: float) -> DataFrame:
    """(clip_id, track_index, segment_index, s_min, s_ext) over normalised samples."""
    split = with_segments(normalize(samples, precision), clips)
    found = split.groupBy(*KEY, "segment_index").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    low, extent = padded_range(F.col("lo"), F.col("hi"))
    return found.select(*KEY, "segment_index", low.alias("s_min"), extent.alias("s_ext"))


def two_level(samples: DataFrame, clips: DataFrame, precision: float) -> DataFrame:
    """Normalises by clip and by segment and back: (…, segment_index, norm2, restored)."""
    split = with_segments(normalize(samples, precision), clips)
    found = split.groupBy(*KEY, "segment_index").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    low, extent = padded_range(F.col("lo"), F.col("hi"))
    met = split.join(found.select(*KEY, "segment_index", low.alias("s_min"), extent.alias("s_ext")), [*KEY, "segment_index"])
    met = met.withColumn("norm2", normalized_value(F.col("norm"), F.col("s_min"), F.col("s_ext")))
    return met.withColumn("restored", (F.col("norm2") * F.col("s_ext") + F.col("s_min")) * F.col("v_ext") + F.col("v_min"))
