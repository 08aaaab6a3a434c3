"""Sampling of raw tracks: requests meet the two keyframes that bracket their time by equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import timeline as tl


def clip_info(samples: DataFrame, rate: float, elements: int = 1, wraps: bool = False) -> DataFrame:
    """One row a clip: num_samples, num_tracks, rate, duration, finite_duration, raw_bytes."""
    sizes = samples.groupBy("clip_id").agg((F.max("sample_index") + 1).alias("num_samples"), (F.max("track_index") + 1).alias("num_tracks"), F.count("*").alias("cells"))
    n = F.col("num_samples")
    return sizes.select(
        "clip_id",
        "num_samples",
        "num_tracks",
        F.lit(rate).alias("sample_rate"),
        tl.duration(n, rate, wraps).alias("duration"),
        tl.finite_duration(n, rate, wraps).alias("finite_duration"),
        (F.col("cells") * (4 * elements)).alias("raw_bytes"),
    )


def time_grid(clips: DataFrame, count: int) -> DataFrame:
    """``count`` evenly spaced times over each clip: (clip_id, request_id, time, ...)."""
    return clips.withColumn("request_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("time", F.col("request_id") * F.col("finite_duration") / (count - 1))


def seek(requests: DataFrame, policy="none", wraps: bool = False) -> DataFrame:
    """Adds key0, key1 and alpha to requests (num_samples, sample_rate, finite_duration, time).

    Times outside the clip are clamped to it.
    """
    end = tl.finite_duration(F.col("num_samples"), F.col("sample_rate"), wraps)
    at = F.greatest(F.lit(0.0), F.least(F.col("time"), end))
    policy = F.lit(policy) if isinstance(policy, str) else policy
    keys = tl.keyframes(F.col("num_samples"), F.col("sample_rate"), at, policy, wraps)
    return requests.withColumn("_k", keys).select("*", "_k.key0", "_k.key1", "_k.alpha").drop("_k")


def sample(samples: DataFrame, sought: DataFrame, track_policy: Callable[[Column], Column] | None = None, width: int = 1) -> DataFrame:
    """Values of all tracks at sought requests: (clip_id, request_id, track_index, v).

    ``track_policy`` names the rounding of a track and applies where requests were sought with
    ``per_track``. To sample one track, filter ``samples`` first: the filter reaches the scan.
    """
    first = samples.select("clip_id", F.col("sample_index").alias("key0"), "track_index", F.col("v").alias("v0"))
    second = samples.select("clip_id", F.col("sample_index").alias("key1"), "track_index", F.col("v").alias("v1"))
    met = sought.join(first, ["clip_id", "key0"]).join(second, ["clip_id", "key1", "track_index"])
    alpha = tl.apply_rounding(F.col("alpha"), track_policy(F.col("track_index"))) if track_policy else F.col("alpha")
    met = met.withColumn("a", alpha)
    value = tl.lerp(F.col("v0"), F.col("v1"), F.col("a")) if width == 1 else F.array(*[tl.lerp(F.col("v0").getItem(i), F.col("v1").getItem(i), F.col("a")) for i in range(width)])
    return met.select("clip_id", "request_id", "track_index", value.alias("v"))


def retained_neighbours(retained: DataFrame) -> DataFrame:
    """For every sample of a clip the closest retained ones: adds before and after.

    ``retained`` (clip_id, segment_index, sample_index, kept) has a row a sample; neighbours
    are looked for within the sample's segment.
    """
    inside = Window.partitionBy("clip_id", "segment_index").orderBy("sample_index")
    key = F.when(F.col("kept"), F.col("sample_index"))
    return retained.withColumns(
        {
            "before": F.last(key, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(key, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
        }
    )


def seek_retained(sought: DataFrame, neighbours: DataFrame, policy: str = "none") -> DataFrame:
    """Moves keys to retained ones; rounding acts on the index, the alpha between them is free."""
    first = neighbours.select("clip_id", F.col("sample_index").alias("key0"), F.col("before").alias("near0"))
    second = neighbours.select("clip_id", F.col("sample_index").alias("key1"), F.col("after").alias("near1"))
    index = F.col("key0") + F.col("alpha")
    return (
        sought.join(first, ["clip_id", "key0"]).join(second, ["clip_id", "key1"])
        .withColumn("alpha", tl.alpha_between(index, F.col("near0"), F.col("near1"), policy))
        .withColumn("key0", F.col("near0")).withColumn("key1", F.col("near1")).drop("near0", "near1")
    )


def fill_gaps(samples: DataFrame, num_samples: int) -> DataFrame:
    """A row for each of ``num_samples`` samples of each track: the last value before a gap, else the next."""
    tracks = samples.select("clip_id", "track_index").distinct()
    grid = tracks.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    over = Window.partitionBy("clip_id", "track_index").orderBy("sample_index")
    last = F.last("v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("v", ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing))
    return grid.join(samples, ["clip_id", "track_index", "sample_index"], "left").withColumn("v", F.coalesce(last, following))
