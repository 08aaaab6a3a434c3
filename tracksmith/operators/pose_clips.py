"""Compressed transform clips as tables: ranges, range reduction, packing and decompression.

A bone has three sub-tracks (rotation, translation, scale) of three components each; a
rotation drops its w, made positive before. A default sub-track is not stored, a constant
one once, an animated one as a code per component and sample. Everything is an equi-join and
a grouped aggregate on (clip_id, bone, sub_track), and one bone is a filter that reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions import packing, qvv
from tracksmith.operators import poses as ps
from tracksmith.operators import sampling

SUB = ["clip_id", "bone", "sub_track"]
NAMES = ("header", "tracks", "codes")
#: Bits of a component that is kept as it is.
RAW_BITS = 32


def components(poses: DataFrame) -> DataFrame:
    """(clip_id, bone, sub_track, sample_index, v): the three components of every sub-track."""
    q = qvv.q_positive_w(F.col("q"))
    parts = F.array(*[F.struct(F.lit(n).alias("sub_track"), v.alias("v")) for n, v in (("rotation", F.slice(q, 1, 3)), ("translation", F.col("t")), ("scale", F.col("s")))])
    return poses.select("clip_id", "bone", "sample_index", F.explode(parts).alias("p")).select("clip_id", "bone", "p.sub_track", "sample_index", "p.v")


def ranges(parts: DataFrame) -> DataFrame:
    """(clip_id, bone, sub_track, lo, ext): least value and extent of each component over the clip."""
    at = [F.col("v").getItem(i) for i in range(3)]
    found = parts.groupBy(*SUB).agg(*[F.min(v).alias(f"lo{i}") for i, v in enumerate(at)], *[F.max(v).alias(f"hi{i}") for i, v in enumerate(at)])
    return found.select(*SUB, F.array("lo0", "lo1", "lo2").alias("lo"), F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3)]).alias("ext"))


def reduced(v: Column, lo: Column, ext: Column) -> Column:
    """Components within 0..1 of their range; 0 where the range is empty."""
    one = lambda i: F.when(ext.getItem(i) < 1e-9, 0.0).otherwise(F.least(F.lit(1.0), (v.getItem(i) - lo.getItem(i)) / F.when(ext.getItem(i) < 1e-9, 1.0).otherwise(ext.getItem(i))))
    return F.array(*[one(i) for i in range(3)])


def range_reduction(parts: DataFrame) -> DataFrame:
    """(clip_id, bone, sub_track, sample_index, x): every sample within its clip range."""
    met = parts.join(ranges(parts), SUB)
    return met.select(*SUB, "sample_index", reduced(F.col("v"), F.col("lo"), F.col("ext")).alias("x"))


@dataclass(frozen=True)
class CompressedPoses:
    """``header`` has a row a clip, ``tracks`` a row a sub-track (class, bits, constant or range),
    ``codes`` a row per sample of an animated sub-track."""

    header: DataFrame
    tracks: DataFrame
    codes: DataFrame

    def write(self, path: str) -> None:
        self.header.write.parquet(f"{path}/header")
        self.tracks.write.parquet(f"{path}/tracks")
        self.codes.repartitionByRange("clip_id", "bone").sortWithinPartitions("clip_id", "bone", "sub_track", "sample_index").write.parquet(f"{path}/codes")

    def only_bone(self, bone: int) -> CompressedPoses:
        return CompressedPoses(self.header, self.tracks.where(F.col("bone") == bone), self.codes.where(F.col("bone") == bone))


def read(spark: SparkSession, path: str) -> CompressedPoses:
    return CompressedPoses(*[spark.read.parquet(f"{path}/{n}") for n in NAMES])


def compress(poses: DataFrame, classes: DataFrame, bits: DataFrame, rate: float) -> CompressedPoses:
    """Compresses ``poses`` by the class of each sub-track and ``bits`` (clip_id, bone, sub_track, bits), 1 to 24 or 32 for raw."""
    parts = components(poses)
    first = parts.groupBy(*SUB).agg(F.min_by("v", "sample_index").alias("first"))
    of = classes.select(*SUB, "class")
    animated = F.col("class") == "animated"
    tracks = (
        of.join(first, SUB).join(ranges(parts), SUB).join(bits.select(*SUB, "bits"), SUB, "left")
        .select(
            *SUB, "class", F.when(animated, F.coalesce("bits", F.lit(RAW_BITS))).otherwise(0).alias("bits"), F.when(F.col("class") == "constant", F.col("first")).alias("constant"),
            *[F.when(animated & (F.coalesce("bits", F.lit(RAW_BITS)) < RAW_BITS), F.col(c)).alias(c) for c in ("lo", "ext")],
        )
    )
    x = reduced(F.col("v"), F.col("lo"), F.col("ext"))
    code = F.array(*[packing.pack_unsigned(x.getItem(i), F.col("bits")) for i in range(3)])
    raw = F.col("bits") == RAW_BITS
    codes = parts.join(tracks.where("class = 'animated'"), SUB).select(*SUB, "sample_index", F.when(~raw, code).alias("code"), F.when(raw, F.col("v")).alias("raw"))
    header = poses.groupBy("clip_id").agg((F.max("sample_index") + 1).alias("num_samples"), F.count_distinct("bone").alias("num_bones")).withColumn("sample_rate", F.lit(rate))
    return CompressedPoses(header, tracks, codes)


def unpacked(code: Column, bits: Column, lo: Column, ext: Column) -> Column:
    """Components from their codes."""
    return F.array(*[packing.unpack_unsigned(code.getItem(i), bits) * ext.getItem(i) + lo.getItem(i) for i in range(3)])


def to_poses(clips: CompressedPoses) -> DataFrame:
    """(clip_id, bone, sample_index, q, t, s): every sample as it decodes; w follows from x, y and z."""
    plain = {"rotation": qvv.vec(0, 0, 0), "translation": qvv.vec(0, 0, 0), "scale": qvv.vec(1, 1, 1)}
    still = clips.tracks.where("class <> 'animated'").join(clips.header.select("clip_id", "num_samples"), "clip_id")
    default = F.when(F.col("sub_track") == "scale", plain["scale"]).otherwise(plain["rotation"])
    still = still.select(*SUB, F.explode(F.sequence(F.lit(0), F.col("num_samples") - 1)).alias("sample_index"), F.coalesce("constant", default).alias("v"))
    moving = clips.codes.join(clips.tracks.select(*SUB, "bits", "lo", "ext"), SUB)
    value = F.coalesce("raw", unpacked(F.col("code"), F.when(F.col("bits") == RAW_BITS, 1).otherwise(F.col("bits")), F.col("lo"), F.col("ext")))
    parts = still.union(moving.select(*SUB, "sample_index", value.alias("v")))
    of = lambda n, name: F.max(F.when(F.col("sub_track") == n, F.col("v"))).alias(name)
    wide = parts.groupBy("clip_id", "bone", "sample_index").agg(of("rotation", "xyz"), of("translation", "t"), of("scale", "s"))
    return wide.select("clip_id", "bone", "sample_index", qvv.q_with_w(F.col("xyz")).alias("q"), "t", "s")


def decompress(clips: CompressedPoses, requests: DataFrame, policy: str = "none", wraps: bool = False) -> DataFrame:
    """Poses of all bones at requests (clip_id, request_id, time): (clip_id, request_id, bone, q, t, s).

    ``wraps`` overrides the clamping of the clip: its end then interpolates to its start.
    """
    head = clips.header.select("clip_id", "num_samples", "sample_rate")
    sought = sampling.seek(requests.select("clip_id", "request_id", "time").join(head, "clip_id"), policy, wraps).select("clip_id", "request_id", "key0", "key1", "alpha")
    return ps.sample_poses(to_poses(clips), sought)


def rounding_used(has_database: bool, is_stripped: bool) -> str:
    """The rounding under which the error of a clip is measured: between missing frames nothing is nearest."""
    return "none" if has_database or is_stripped else "nearest"


def trivial_defaults(defaults: DataFrame, additive1: bool = False) -> DataFrame:
    """(clip_id, trivial): whether all default values (clip_id, bone, q, t, s) are the identity, of scale 0 for ``additive1``."""
    scale = qvv.vec(*[0.0 if additive1 else 1.0] * 3)
    same = (F.col("q") == qvv.vec(*qvv.IDENTITY_Q)) & (F.col("t") == qvv.vec(0, 0, 0)) & (F.col("s") == scale)
    return defaults.groupBy("clip_id").agg(F.bool_and(same).alias("trivial"))
