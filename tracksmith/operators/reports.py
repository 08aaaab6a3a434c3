"""Reports over compression runs: aggregates, percentiles, shares, curves and sweeps.

``runs`` (clip_id, algorithm, raw_size, compressed_size, ratio, num_constant, num_animated,
num_tracks, max_error, …).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.model import BIT_RATES
from tracksmith.operators import buckets


def by_type(runs: DataFrame) -> DataFrame:
    """Totals of each run type and of all (algorithm null)."""
    return runs.rollup("algorithm").agg(
        F.count("*").alias("num_runs"),
        F.sum("raw_size").alias("raw_size"),
        F.sum("compressed_size").alias("compressed_size"),
        (F.sum("raw_size") / F.sum("compressed_size")).alias("ratio"),
        F.max("max_error").alias("max_error"),
    )


def best_worst(runs: DataFrame) -> DataFrame:
    """One row a run type: the clips of the best and worst error and ratio; ties go to the smaller clip."""
    def key(v: str, sign: int) -> Column:
        return F.struct(F.col(v) * sign, F.col("clip_id"))

    return runs.groupBy("algorithm").agg(
        F.min_by("clip_id", key("max_error", 1)).alias("best_error_clip"),
        F.min_by("clip_id", key("ratio", -1)).alias("best_ratio_clip"),
        F.min_by("clip_id", key("max_error", -1)).alias("worst_error_clip"),
        F.min_by("clip_id", key("ratio", 1)).alias("worst_ratio_clip"),
    )


def percentiles(df: DataFrame, value: str, points: Sequence[float], by: list[str] | None = None) -> DataFrame:
    """(point, value) by linear interpolation, exactly.

    Values are counted in buckets; only buckets that hold a rank asked for are sorted, each by itself.
    """
    by, v = by or [], F.col(value)
    rows = df.where(v.isNotNull()).select(*by, v.cast("double").alias("_v"))
    total, found = rows.agg(F.count("*"), buckets.points(F.col("_v"))).first()
    rows = rows.withColumn("_part", buckets.part(F.col("_v"), *buckets.bounds(found, total)))
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), (F.sum("_n").over(group) - 1).alias("_last"))
    at = spans.select("*", F.posexplode(F.lit([float(p) for p in points])).alias("_i", "point")).withColumn("_x", F.col("point") * F.col("_last"))
    ends = at.select("*", F.explode(F.array(F.floor("_x"), F.ceil("_x"))).alias("_k"), (F.col("_x") - F.floor("_x")).alias("_share")).distinct()
    ends = ends.where("_k >= _before AND _k < _before + _n").withColumn("_place", F.col("_k") - F.col("_before") + 1)
    even = F.col("_least") == F.col("_most")
    sought = ends.where(~even).select(*by, "_part", "_i", "point", "_k", "_share", "_place")
    local = Window.partitionBy(*by, "_part").orderBy("_v")
    held = rows.join(F.broadcast(sought.select(*by, "_part").distinct()), [*by, "_part"], "left_semi").withColumn("_place", F.row_number().over(local).cast("long"))
    keep = [*by, "_i", "point", "_k", "_share", "_v"]
    met = held.join(F.broadcast(sought), [*by, "_part", "_place"]).select(*keep).union(ends.where(even).withColumn("_v", F.col("_least")).select(*keep))
    low, high = F.min_by("_v", "_k"), F.max_by("_v", "_k")
    return met.groupBy(*by, "_i", "point").agg((low + F.max("_share") * (high - low)).alias("value")).select(*by, "point", "value")


def percentile_rank(df: DataFrame, value: str, at: float, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg((F.avg((F.col(value) < at).cast("double")) * 100.0).alias("rank"))


def class_ratios(tracks: DataFrame) -> DataFrame:
    """Share of default, constant and animated sub-tracks, by kind and overall (sub_track null)."""
    share = lambda c: (F.avg((F.col("class") == c).cast("double")) * 100.0).alias(f"{c}_pct")
    return tracks.groupingSets([["sub_track"], []], "sub_track").agg(F.count("*").alias("n"), share("default"), share("constant"), share("animated"))


def size_shares(runs: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Each part's share of a size by run type: the 50th and 99th percentile over clips."""
    shares = [F.percentile(F.col(p) / F.col(total) * 100.0, F.array(F.lit(0.5), F.lit(0.99))).alias(p) for p in parts]
    got = runs.groupBy("algorithm").agg(*shares)
    return got.select("algorithm", *[c for p in parts for c in (F.col(p).getItem(0).alias(f"{p}_p50"), F.col(p).getItem(1).alias(f"{p}_p99"))])


def summary_curves(runs: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """(place, one column an ordering): value column v ordered by column k, for each (v, k), side by side."""
    out = None
    for value, key in keys:
        order = Window.orderBy(key, "clip_id", "algorithm")
        one = runs.select((F.row_number().over(order) - 1).alias("place"), F.col(value).alias(f"{value}_by_{key}"))
        out = one if out is None else out.join(one, "place")
    return out


def unpivot_rates(histograms: DataFrame) -> DataFrame:
    """Columns rate_0..rate_24 to rows (algorithm, bit_rate, n)."""
    names = [f"rate_{i}" for i in range(len(BIT_RATES))]
    long = histograms.unpivot("algorithm", names, "rate", "n")
    return long.select("algorithm", F.substring("rate", 6, 2).cast("int").alias("bit_rate"), "n")


def pivot_rates(rates: DataFrame) -> DataFrame:
    """A row an algorithm, a column a rate."""
    got = rates.groupBy("algorithm").pivot("bit_rate", list(range(len(BIT_RATES)))).agg(F.count(F.lit(1)))
    return got.select("algorithm", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"rate_{i}") for i in range(len(BIT_RATES))])


def median_benchmarks(rows: DataFrame) -> DataFrame:
    """Of benchmark rows (name, aggregate, real_time, speed) the forward medians, a column a function."""
    kept = rows.where((F.col("aggregate") == "median") & F.contains("name", F.lit("Dir:0")))
    func = F.regexp_extract("name", r"Func:(\d+)", 1)
    clip = F.regexp_extract("name", r"^([^/]*)", 1)
    return kept.select(clip.alias("clip"), func.alias("func"), "real_time").groupBy("clip").pivot("func", ["0", "1"]).agg(F.max("real_time")).withColumnsRenamed({"0": "pose", "1": "bone"})


def benchmark_deltas(rows: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Per clip a column a version (clip, version, us), and the change from the first to the last in per cent."""
    got = rows.groupBy("clip").pivot("version", list(versions)).agg(F.max("us"))
    first, last = F.col(f"`{versions[0]}`"), F.col(f"`{versions[-1]}`")
    return got.withColumn("delta_pct", (last - first) / first * 100.0)


def rate_permutations(spark, dof: int) -> DataFrame:
    """All tuples of 25 rates by total bits, then values: (place, total_bits, r0, …)."""
    one = spark.range(len(BIT_RATES)).select(F.col("id").cast("int").alias("r"))
    out = one.withColumnRenamed("r", "r0")
    for i in range(1, dof):
        out = out.crossJoin(one.withColumnRenamed("r", f"r{i}"))
    names = [f"r{i}" for i in range(dof)]
    bits = sum((F.when(F.col(n) == len(BIT_RATES) - 1, 32).otherwise(F.col(n)) for n in names), F.lit(0))
    out = out.withColumn("total_bits", bits)
    return out.select((F.row_number().over(Window.orderBy("total_bits", *names)) - 1).alias("place"), "total_bits", *names)


def settings_sweep(clips: DataFrame) -> DataFrame:
    """Every clip with each of the four combinations of rotation and vector formats."""
    spark = clips.sparkSession
    formats = [(r, v) for r in ("quatf_drop_w_variable", "quatf_full") for v in ("vector3f_variable", "vector3f_full")]
    return clips.crossJoin(F.broadcast(spark.createDataFrame(formats, "rotation_format string, vector_format string")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
