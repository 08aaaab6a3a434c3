"""Compressed scalar clips as tables: writing, reading, validity, decompression and conversion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions import packing
from tracksmith.model import FORMAT_VERSION, RAW_RATE
from tracksmith.operators import sampling, scalar

HEADER = "clip_id bigint, name string, version int, num_samples int, num_tracks int, sample_rate double, looping string, content_hash bigint"
NAMES = ("header", "tracks", "codes")


@dataclass(frozen=True)
class CompressedClips:
    """``header`` has a row a clip, ``tracks`` a row a track (rate, constant or range, metadata),
    ``codes`` a row per sample of an animated track: its code, or its value where the track is raw."""

    header: DataFrame
    tracks: DataFrame
    codes: DataFrame

    def write(self, path: str) -> None:
        """Codes are sorted by clip, track and sample, so that one clip or track prunes row groups."""
        self.header.write.parquet(f"{path}/header")
        self.tracks.write.parquet(f"{path}/tracks")
        self.codes.repartitionByRange("clip_id", "track_index").sortWithinPartitions("clip_id", "track_index", "sample_index").write.parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> CompressedClips:
    return CompressedClips(*[spark.read.parquet(f"{path}/{n}") for n in NAMES])


def _row_hash(df: DataFrame, *columns: str) -> Column:
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))


def _content_hash(tracks: DataFrame, codes: DataFrame) -> DataFrame:
    """(clip_id, content_hash): free of row order."""
    a = tracks.groupBy("clip_id").agg(_row_hash(tracks, "track_index", "bit_rate", "is_constant", "constant", "v_min", "v_ext").alias("a"))
    b = codes.groupBy("clip_id").agg(_row_hash(codes, "track_index", "sample_index", "code", "raw").alias("b"))
    return a.join(b, "clip_id", "left").select("clip_id", F.xxhash64("a", "b").alias("content_hash"))


def compress(samples: DataFrame, precision, rate: float, names: DataFrame | None = None, looping: str = "clamp") -> CompressedClips:
    """Compresses (clip_id, track_index, sample_index, v). ``names`` (clip_id, track_index, name) is kept as metadata."""
    rates = scalar.bit_rates(samples, precision)
    q = scalar.quantize(samples, rates)
    first = samples.groupBy(*scalar.KEY).agg(F.min_by("v", "sample_index").alias("first"))
    ranged = ~F.col("is_constant") & (F.col("bit_rate") < RAW_RATE)
    tracks = rates.join(first, scalar.KEY).select(
        *scalar.KEY,
        "bit_rate",
        "is_constant",
        F.when(F.col("is_constant"), F.col("first")).alias("constant"),
        F.when(ranged, F.col("v_min")).alias("v_min"),
        F.when(ranged, F.col("v_ext")).alias("v_ext"),
    )
    tracks = tracks.join(names, scalar.KEY, "left") if names is not None else tracks.withColumn("name", F.lit(""))
    codes = q.where("bit_rate > 0").select(*scalar.KEY, "sample_index", "code", F.when(F.col("bit_rate") == RAW_RATE, F.col("v")).alias("raw"))
    info = sampling.clip_info(samples, rate).select("clip_id", F.lit("").alias("name"), F.lit(FORMAT_VERSION).alias("version"), "num_samples", "num_tracks", "sample_rate", F.lit(looping).alias("looping"))
    return CompressedClips(info.join(_content_hash(tracks, codes), "clip_id"), tracks, codes)


def validity(clips: CompressedClips) -> DataFrame:
    """(clip_id, is_valid): a known version and the content that the header names."""
    found = _content_hash(clips.tracks, clips.codes).withColumnRenamed("content_hash", "found")
    ok = (F.col("version") == FORMAT_VERSION) & F.col("content_hash").eqNullSafe(F.col("found"))
    return clips.header.join(found, "clip_id", "left").select("clip_id", ok.alias("is_valid"))


def to_samples(clips: CompressedClips) -> DataFrame:
    """All samples as they decode: constants repeated, raw values kept, codes restored."""
    grid = clips.tracks.where("is_constant").join(clips.header.select("clip_id", "num_samples"), "clip_id")
    still = grid.select(*scalar.KEY, F.explode(F.sequence(F.lit(0), F.col("num_samples") - 1)).alias("sample_index"), F.col("constant").alias("v"))
    moving = clips.codes.join(clips.tracks.select(*scalar.KEY, "bit_rate", "v_min", "v_ext"), scalar.KEY)
    bits = F.when(F.col("bit_rate") == RAW_RATE, 1).otherwise(F.col("bit_rate"))
    value = F.when(F.col("bit_rate") == RAW_RATE, F.col("raw")).otherwise(packing.unpack_unsigned(F.col("code"), bits) * F.col("v_ext") + F.col("v_min"))
    return still.union(moving.select(*scalar.KEY, "sample_index", value.alias("v")))


def decompress(clips: CompressedClips, requests: DataFrame, policy: str = "none", track_policy: Callable[[Column], Column] | None = None) -> DataFrame:
    """Values of all tracks at requests (clip_id, request_id, time). Filter the tables first to decode one track."""
    head = clips.header.select("clip_id", "num_samples", "sample_rate")
    sought = sampling.seek(requests.select("clip_id", "request_id", "time").join(head, "clip_id"), policy).select("clip_id", "request_id", "key0", "key1", "alpha")
    return sampling.sample(to_samples(clips), sought, track_policy)


def only_track(clips: CompressedClips, track_index: int) -> CompressedClips:
    keep = F.col("track_index") == track_index
    return CompressedClips(clips.header, clips.tracks.where(keep), clips.codes.where(keep))
