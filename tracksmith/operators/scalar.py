"""The scalar pipeline: ranges, constants, normalisation, bit rates, quantisation, sizes, error.

Tables are (clip_id, track_index, sample_index, v). Everything about a track is one aggregate
of its samples; the trial of bit rates is 23 error columns of one aggregate, not 23 passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import packing
from tracksmith.model import HIGHEST_RATE, RAW_RATE

KEY = ["clip_id", "track_index"]
TINY = 1e-9


def require_finite(samples: DataFrame) -> DataFrame:
    """Fails on the first sample that is null, NaN or infinite."""
    v = F.col("v")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return samples.withColumn("v", F.when(bad, F.raise_error(F.lit("Some samples are not finite")).cast("double")).otherwise(v))


def ranges(samples: DataFrame) -> DataFrame:
    """(clip_id, track_index, v_min, v_ext)."""
    return samples.groupBy(*KEY).agg(F.min("v").alias("v_min"), (F.max("v") - F.min("v")).alias("v_ext"))


def constant_tracks(samples: DataFrame, precision) -> DataFrame:
    """Adds is_constant to the ranges: the extent is below the precision, strictly."""
    p = precision if isinstance(precision, Column) else F.lit(precision)
    return ranges(samples).withColumn("is_constant", F.abs("v_ext") < p)


def normalized_value(v, low, extent) -> Column:
    e = F.when(extent < TINY, 1.0).otherwise(extent)
    return F.when(extent < TINY, 0.0).otherwise(F.least(F.lit(1.0), (v - low) / e))


def normalize(samples: DataFrame, precision) -> DataFrame:
    """Adds norm to the samples of tracks that are not constant, and the track's range."""
    return samples.join(constant_tracks(samples, precision).where("NOT is_constant"), KEY).withColumn("norm", normalized_value(F.col("v"), F.col("v_min"), F.col("v_ext")))


def restored(norm: Column, bits, low: Column, extent: Column) -> Column:
    """A value after packing to ``bits`` and back."""
    return packing.decay(norm, bits) * extent + low


def bit_rates(samples: DataFrame, precision) -> DataFrame:
    """(clip_id, track_index, is_constant, bit_rate, v_min, v_ext).

    The search walks down from 23 bits and stops at the first rate with an error above the
    precision: one above the highest failing rate. 24 is raw, 0 constant.
    """
    p = precision if isinstance(precision, Column) else F.lit(precision)
    both = samples.join(constant_tracks(samples, p), KEY)
    norm = normalized_value(F.col("v"), F.col("v_min"), F.col("v_ext"))
    tried = both.withColumn("norm", norm)
    fails = [F.max(F.abs(restored(F.col("norm"), b, F.col("v_min"), F.col("v_ext")) - F.col("v"))).alias(f"e{b}") for b in range(1, HIGHEST_RATE + 1)]
    errors = tried.groupBy(*KEY, "v_min", "v_ext", "is_constant").agg(*fails)
    worst = F.greatest(*[F.when(F.col(f"e{b}") > p, b).otherwise(0) for b in range(1, HIGHEST_RATE + 1)])
    return errors.select(*KEY, "is_constant", F.when(F.col("is_constant"), 0).otherwise(worst + 1).cast("int").alias("bit_rate"), "v_min", "v_ext")


def quantize(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """The animated tracks' codes and what they decode to: (…, bit_rate, code, lossy).

    Raw tracks keep their value and have no code. Constant tracks are their first sample.
    """
    met = samples.join(rates, KEY)
    first = F.first("v").over(Window.partitionBy(*KEY).orderBy("sample_index"))
    norm = normalized_value(F.col("v"), F.col("v_min"), F.col("v_ext"))
    raw, constant = F.col("bit_rate") == RAW_RATE, F.col("is_constant")
    met = met.withColumn("norm", norm).withColumn("start", first)
    bits = F.when(raw | constant, 1).otherwise(F.col("bit_rate"))
    return met.select(
        *KEY,
        "sample_index",
        "v",
        "bit_rate",
        F.when(~raw & ~constant, packing.pack_unsigned(F.col("norm"), bits)).alias("code"),
        F.when(constant, F.col("start")).when(raw, F.col("v")).otherwise(restored(F.col("norm"), bits, F.col("v_min"), F.col("v_ext"))).alias("lossy"),
    )


def compressed_sizes(rates: DataFrame, clips: DataFrame) -> DataFrame:
    """Bits a frame and bytes a clip: rates (1 a track), constants, ranges and animated data.

    Ranges are kept for tracks neither constant nor raw; parts are aligned to 4 bytes.
    """
    bits = packing.bits_of_rate(F.col("bit_rate"))
    agg = rates.groupBy("clip_id").agg(
        F.count("*").alias("num_tracks"),
        F.count_if("is_constant").alias("num_constant"),
        F.count_if((F.col("bit_rate") > 0) & (F.col("bit_rate") < RAW_RATE)).alias("num_ranged"),
        F.sum(bits).alias("bits_per_frame"),
    )
    met = agg.join(clips.select("clip_id", "num_samples", "raw_bytes"), "clip_id")
    data = F.ceil(F.col("bits_per_frame") * F.col("num_samples") / 8)
    size = packing.align_to(F.col("num_tracks"), 4) + F.col("num_constant") * 4 + F.col("num_ranged") * 8 + packing.align_to(data, 4)
    return met.withColumn("compressed_bytes", size.cast("long")).withColumn("ratio", F.col("raw_bytes") / F.col("compressed_bytes"))


def errors(quantized: DataFrame) -> DataFrame:
    """Error of each track at each sample: (clip_id, track_index, sample_index, error)."""
    return quantized.select(*KEY, "sample_index", F.abs(F.col("lossy") - F.col("v")).alias("error"))


def worst_error(found: DataFrame, rate: float) -> DataFrame:
    """(clip_id, track_index, error, time): the greatest error; of equal ones the earliest sample, then track."""
    worst = F.max_by(F.struct("track_index", "sample_index", "error"), F.struct("error", -F.col("sample_index"), -F.col("track_index")))
    last = F.max("sample_index")
    return found.groupBy("clip_id").agg(worst.alias("w"), last.alias("n")).select(
        "clip_id", "w.track_index", "w.error", F.least(F.col("w.sample_index") / rate, F.col("n") / rate).alias("time")
    )


def loops(samples: DataFrame, precision: float) -> DataFrame:
    """(clip_id, num_samples, loops): first and last sample agree within the precision on all tracks."""
    ends = samples.groupBy(*KEY).agg(F.min_by("v", "sample_index").alias("first"), F.max_by("v", "sample_index").alias("last"), F.count("*").alias("n"))
    return ends.groupBy("clip_id").agg(
        F.max("n").alias("num_samples"), ((F.max("n") > 1) & F.bool_and(F.abs(F.col("last") - F.col("first")) <= precision)).alias("loops")
    )


def trim_loops(samples: DataFrame, precision: float) -> DataFrame:
    """Drops the last sample of looping clips, which wrap from then on."""
    return samples.join(loops(samples, precision), "clip_id").where("NOT loops OR sample_index < num_samples - 1").select(*samples.columns)


def close_loops(samples: DataFrame, precision: float) -> DataFrame:
    """Copies the first sample over the last one of looping clips."""
    first = samples.where("sample_index = 0").select(*KEY, F.col("v").alias("first"))
    met = samples.join(loops(samples, precision), "clip_id").join(first, KEY, "left")
    return met.withColumn("v", F.when(F.col("loops") & (F.col("sample_index") == F.col("num_samples") - 1), F.col("first")).otherwise(F.col("v"))).select(*samples.columns)


def sanitize_constant(samples: DataFrame, precision: float, whole_range: bool = True) -> DataFrame:
    """Replaces tracks whose extent is at most the precision by their first sample.

    With ``whole_range`` off, the maximum starts from the last sample and the first one only
    counts for the minimum, as the established pre-pass does: it misses a maximum at the start.
    """
    top = F.max("v") if whole_range else F.greatest(F.max(F.when(F.col("sample_index") > 0, F.col("v"))), F.max_by("v", "sample_index"))
    flat = samples.groupBy(*KEY).agg(F.min_by("v", "sample_index").alias("first"), (top - F.min("v") <= precision).alias("flat"))
    return samples.join(flat, KEY).withColumn("v", F.when(F.col("flat"), F.col("first")).otherwise(F.col("v"))).select(*samples.columns)


def remap_outputs(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renames tracks by (track_index, output_index); tracks without an output go."""
    return samples.join(mapping.where("output_index IS NOT NULL"), "track_index").withColumn("track_index", F.col("output_index")).select(*samples.columns)
