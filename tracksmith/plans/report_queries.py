"""Queries on keyframes, tiers, transform compression and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.model import DatabaseSettings
from tracksmith.operators import keyframes, reports, scalar, segments, tiers, transform
from tracksmith.operators import poses as ps
from tracksmith.plans.pose_queries import POSES, _CLASSES, _STILL, _classes, poses_of
from tracksmith.plans.track_queries import _SEGS, _SIZES, T1, T1C, Query, _quant_sql, _quantized, _rates_sql, clips_of
from tracksmith.sources import views

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LEVELS = (("coarse", 0.05), ("medium", 0.01), ("fine", 0.001))


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- error reports ----------------------------------------------------------------------------

_ERRORS = f"{T1}, {_quant_sql(0.01)}, ee AS (SELECT clip_id, track_index, sample_index, abs(lossy - v) AS error FROM qz)"


def _errors(spark, sf_dir) -> DataFrame:
    return scalar.errors(_quantized(spark, sf_dir, 0.01))


@add("error_percentiles", f"WITH {_ERRORS}, q AS (SELECT clip_id, quantile_cont(error, [0.5, 0.85, 0.99]) AS p FROM ee GROUP BY 1) SELECT clip_id, [0.5, 0.85, 0.99][i]::DOUBLE AS point, round(p[i], 8) AS value FROM q, range(1, 4) r(i)")
def error_percentiles(spark, sf_dir):
    return reports.percentiles(_errors(spark, sf_dir), "error", (0.5, 0.85, 0.99), ["clip_id"]).withColumn("value", F.round("value", 8))


@add("error_percentile_rank", f"WITH {_ERRORS} SELECT clip_id, round(avg(CASE WHEN error < 0.004 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS rank FROM ee GROUP BY 1")
def error_rank(spark, sf_dir):
    return reports.percentile_rank(_errors(spark, sf_dir), "error", 0.004, ["clip_id"]).withColumn("rank", F.round("rank", 6))


_POINTS = [i / 1000 for i in range(1001)]
_TAIL = [0.9 + i / 10000 for i in range(1001)]
for _name, _points, _sql in (("full_error_curve", _POINTS, "i / 1000.0::DOUBLE"), ("error_curve_tail", _TAIL, "least(1.0, 0.9::DOUBLE + i / 10000.0::DOUBLE)")):
    add(_name, f"WITH {_ERRORS}, s AS (SELECT error, row_number() OVER (ORDER BY error) - 1 AS k, count(*) OVER () AS n FROM ee), pt AS (SELECT i, {_sql} AS pos FROM range(1001) r(i)), b AS (SELECT pt.pos, pt.pos * (SELECT count(*) - 1 FROM ee) AS x FROM pt) SELECT round(pos, 4) AS point, round(l.error + (x - floor(x)) * (h.error - l.error), 7) AS value FROM b JOIN s l ON l.k = CAST(floor(x) AS BIGINT) JOIN s h ON h.k = CAST(ceil(x) AS BIGINT)")(
        lambda spark, sf_dir, p=_points: reports.percentiles(_errors(spark, sf_dir), "error", [min(1.0, x) for x in p]).select(F.round("point", 4).alias("point"), F.round("value", 7).alias("value"))
    )

# --- runs -------------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    """A run a clip and precision."""
    out, tracks, clips = None, views.embedding_tracks(spark, sf_dir), clips_of(spark, sf_dir)
    for name, precision in LEVELS:
        rates = scalar.bit_rates(tracks, precision)
        worst = scalar.errors(scalar.quantize(tracks, rates)).groupBy("clip_id").agg(F.max("error").alias("max_error"))
        sizes = scalar.compressed_sizes(rates, clips)
        one = sizes.join(worst, "clip_id").select(
            "clip_id", F.lit(name).alias("algorithm"), F.col("raw_bytes").alias("raw_size"), F.col("compressed_bytes").alias("compressed_size"),
            (F.col("raw_bytes") / F.col("compressed_bytes")).alias("ratio"), F.round("max_error", 8).alias("max_error"),
            (F.col("num_tracks") + F.col("num_ranged") * 8).alias("metadata_size"),
        )
        out = one if out is None else out.union(one)
    return out


def _run_sql(name: str, precision: float) -> str:
    body = f"WITH {T1C}, {_quant_sql(precision)}, {_SIZES}, w AS (SELECT clip_id, round(max(abs(lossy - v)), 8) AS max_error FROM qz GROUP BY 1)"
    return f"({body} SELECT clip_id, '{name}' AS algorithm, raw_bytes AS raw_size, compressed_bytes AS compressed_size, raw_bytes / compressed_bytes AS ratio, max_error, num_tracks + num_ranged * 8 AS metadata_size FROM cs JOIN w USING (clip_id))"


RUNS = "runs AS (" + " UNION ALL ".join(f"SELECT * FROM {_run_sql(n, p)}" for n, p in LEVELS) + ")"


@add("runs_by_type", f"WITH {RUNS} SELECT algorithm, count(*) AS num_runs, sum(raw_size)::BIGINT AS raw_size, sum(compressed_size)::BIGINT AS compressed_size, round(sum(raw_size) / sum(compressed_size), 6) AS ratio, max(max_error) AS max_error FROM runs GROUP BY ROLLUP (algorithm)")
def runs_by_type(spark, sf_dir):
    return reports.by_type(_runs(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@add("best_worst_runs", f"""WITH {RUNS} SELECT algorithm, arg_min(clip_id, (max_error, clip_id)) AS best_error_clip, arg_min(clip_id, (-ratio, clip_id)) AS best_ratio_clip,
  arg_min(clip_id, (-max_error, clip_id)) AS worst_error_clip, arg_min(clip_id, (ratio, clip_id)) AS worst_ratio_clip FROM runs GROUP BY 1""")  # fmt: skip
def best_worst_runs(spark, sf_dir):
    return reports.best_worst(_runs(spark, sf_dir))


@add("run_size_shares", f"WITH {RUNS} SELECT algorithm, round(quantile_cont(metadata_size / compressed_size * 100.0, 0.5), 6) AS metadata_size_p50, round(quantile_cont(metadata_size / compressed_size * 100.0, 0.99), 6) AS metadata_size_p99 FROM runs GROUP BY 1")
def run_size_shares(spark, sf_dir):
    got = reports.size_shares(_runs(spark, sf_dir), ["metadata_size"], "compressed_size")
    return got.withColumns({c: F.round(c, 6) for c in ("metadata_size_p50", "metadata_size_p99")})


_CURVES = (("ratio", "ratio"), ("max_error", "max_error"), ("compressed_size", "compressed_size"), ("ratio", "max_error"), ("max_error", "ratio"), ("ratio", "compressed_size"))


@add("summary_curves", f"WITH {RUNS}" + "".join(f", c{i} AS (SELECT row_number() OVER (ORDER BY {k}, clip_id, algorithm) - 1 AS place, {v} AS {v}_by_{k} FROM runs)" for i, (v, k) in enumerate(_CURVES)) + " SELECT CAST(place AS INT) AS place, " + ", ".join(f"round({v}_by_{k}, 6) AS {v}_by_{k}" if v != "compressed_size" else f"{v}_by_{k}" for v, k in _CURVES) + " FROM c0 " + " ".join(f"JOIN c{i} USING (place)" for i in range(1, 6)))
def summary_curves(spark, sf_dir):
    got = reports.summary_curves(_runs(spark, sf_dir), _CURVES)
    return got.withColumns({f"{v}_by_{k}": F.round(f"{v}_by_{k}", 6) for v, k in _CURVES if v != "compressed_size"})


@add("class_ratios", f"WITH {POSES}, {_STILL}, {_CLASSES} SELECT sub_track, count(*) AS n, round(avg((class = 'default')::INT) * 100.0, 6) AS default_pct, round(avg((class = 'constant')::INT) * 100.0, 6) AS constant_pct, round(avg((class = 'animated')::INT) * 100.0, 6) AS animated_pct FROM cl GROUP BY GROUPING SETS ((sub_track), ())")
def class_ratios(spark, sf_dir):
    got = reports.class_ratios(_classes(spark, sf_dir)[1])
    return got.withColumns({c: F.round(c, 6) for c in ("default_pct", "constant_pct", "animated_pct")})


@add("bit_rate_pivot", f"WITH {T1}, {_rates_sql(0.01)} SELECT 'medium' AS algorithm, " + ", ".join(f"count(*) FILTER (bit_rate = {i}) AS rate_{i}" for i in range(25)) + " FROM rt")
def bit_rate_pivot(spark, sf_dir):
    return reports.pivot_rates(scalar.bit_rates(views.embedding_tracks(spark, sf_dir), 0.01).withColumn("algorithm", F.lit("medium")))


@add("bit_rate_table", f"WITH {T1}, {_rates_sql(0.01)} SELECT 'medium' AS algorithm, CAST(b AS INT) AS bit_rate, count(rt.bit_rate) AS n FROM range(25) r(b) LEFT JOIN rt ON rt.bit_rate = b GROUP BY ALL")
def bit_rate_table(spark, sf_dir):
    return reports.unpivot_rates(bit_rate_pivot(spark, sf_dir))


for _dof in (1, 2, 3):
    _names = [f"r{i}" for i in range(_dof)]
    _bits = " + ".join(f"CASE WHEN {n} = 24 THEN 32 ELSE {n} END" for n in _names)
    add(f"rate_permutations_{_dof}", f"WITH r AS (SELECT {', '.join(f'CAST({n} AS INT) AS {n}' for n in _names)}, CAST({_bits} AS INT) AS total_bits FROM {', '.join(f'range(25) t{i}({n})' for i, n in enumerate(_names))}) SELECT CAST(row_number() OVER (ORDER BY total_bits, {', '.join(_names)}) - 1 AS INT) AS place, total_bits, {', '.join(_names)} FROM r")(
        lambda spark, sf_dir, d=_dof: reports.rate_permutations(spark, d)
    )


@add("settings_sweep", "SELECT DISTINCT CAST(label AS BIGINT) AS clip_id, r AS rotation_format, v AS vector_format FROM embeddings, (VALUES ('quatf_full'), ('quatf_drop_w_variable')) a(r), (VALUES ('vector3f_full'), ('vector3f_variable')) b(v)")
def settings_sweep(spark, sf_dir):
    return reports.settings_sweep(clips_of(spark, sf_dir).select("clip_id"))


_BENCH = "SELECT 'clip_' || label || '/Dir:' || (vec_id % 2) || '/Func:' || (vec_id % 3) AS name, CASE WHEN vec_id % 5 < 3 THEN 'median' ELSE 'mean' END AS aggregate, round(abs(embedding[1]::DOUBLE) * 10, 4) AS real_time, 'v' || (vec_id % 3) AS version, label FROM embeddings"


def _bench(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    return views.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("clip_"), "label", F.lit("/Dir:"), v % 2, F.lit("/Func:"), v % 3).alias("name"),
        F.when(v % 5 < 3, "median").otherwise("mean").alias("aggregate"),
        F.round(F.abs(F.col("embedding").getItem(0).cast("double")) * 10, 4).alias("real_time"),
        F.concat(F.lit("v"), v % 3).alias("version"),
        F.concat(F.lit("clip_"), "label").alias("clip"),
    )


@add("median_benchmarks", f"WITH b AS ({_BENCH}) SELECT split_part(name, '/', 1) AS clip, round(max(real_time) FILTER (name LIKE '%Func:0'), 3)::DOUBLE AS pose, round(max(real_time) FILTER (name LIKE '%Func:1'), 3)::DOUBLE AS bone FROM b WHERE aggregate = 'median' AND name LIKE '%Dir:0%' GROUP BY 1")
def median_benchmarks(spark, sf_dir):
    return reports.median_benchmarks(_bench(spark, sf_dir)).withColumns({"pose": F.round("pose", 3).cast("double"), "bone": F.round("bone", 3).cast("double")})


@add("benchmark_deltas", f"WITH b AS ({_BENCH}), p AS (SELECT 'clip_' || label AS clip, max(real_time) FILTER (version = 'v0')::DOUBLE AS v0, max(real_time) FILTER (version = 'v1')::DOUBLE AS v1, max(real_time) FILTER (version = 'v2')::DOUBLE AS v2 FROM b GROUP BY 1) SELECT clip, round(v0, 3) AS v0, round(v1, 3) AS v1, round(v2, 3) AS v2, round((v2 - v0) / v0 * 100.0, 3) AS delta_pct FROM p")
def benchmark_deltas(spark, sf_dir):
    rows = _bench(spark, sf_dir).withColumn("us", F.col("real_time").cast("double"))
    got = reports.benchmark_deltas(rows, ("v0", "v1", "v2"))
    return got.withColumns({c: F.round(c, 3) for c in ("v0", "v1", "v2", "delta_pct")})


# --- keyframes and tiers ----------------------------------------------------------------------


def segmented(df: DataFrame) -> DataFrame:
    clips = df.groupBy("clip_id").agg((F.max("sample_index") + 1).alias("num_samples"))
    return segments.with_segments(df, clips)


def _proxy(spark, sf_dir) -> DataFrame:
    """Second differences, rounded so that both engines rank alike."""
    got = keyframes.proxy_error(segmented(views.embedding_frames(spark, sf_dir)))
    return got


_PROXY = f"""{T1C}, {_SEGS}, b AS (SELECT t.clip_id, t.sample_index, sg, t.track_index, v, lag(v) OVER w AS u, lead(v) OVER w AS x FROM t1 t JOIN segs ON segs.clip_id = t.clip_id AND t.sample_index >= s0 AND t.sample_index < s0 + sz
    WINDOW w AS (PARTITION BY t.clip_id, t.track_index, sg ORDER BY t.sample_index)),
  px AS (SELECT clip_id, CAST(sg AS INT) AS segment_index, sample_index, CASE WHEN max(CASE WHEN u IS NULL OR x IS NULL THEN 1 ELSE 0 END) = 1 THEN 'inf'::DOUBLE ELSE sqrt(sum((u + x - 2.0 * v) * (u + x - 2.0 * v))) END AS error FROM b GROUP BY 1, 2, 3),
  ps AS (SELECT *, row_number() OVER (PARTITION BY clip_id, segment_index ORDER BY error, sample_index) - 1 AS position, error < 'inf'::DOUBLE AS movable FROM px)"""


@add("stripping_order", f"""WITH {_PROXY}, rn AS (SELECT *, max(error) OVER (PARTITION BY clip_id, segment_index ORDER BY position) AS m FROM ps)
  SELECT clip_id, segment_index, sample_index, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY m, segment_index DESC, position) - 1 AS INT) AS stripping_index FROM rn""")  # fmt: skip
def stripping_order(spark, sf_dir):
    return keyframes.stripping_order(_proxy(spark, sf_dir)).select("clip_id", "segment_index", "sample_index", "stripping_index")


@add("strip_keyframes", f"""WITH {_PROXY}, rn AS (SELECT *, max(error) OVER (PARTITION BY clip_id, segment_index ORDER BY position) AS m FROM ps),
  so AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY m, segment_index DESC, position) - 1 AS k, count(*) OVER (PARTITION BY clip_id) AS n, count(*) FILTER (movable) OVER (PARTITION BY clip_id) AS most FROM rn),
  ct AS (SELECT clip_id, least(max(most), greatest(coalesce(min(k) FILTER (error > 3.5), max(n)), floor(max(n) * 0.1::DOUBLE))) AS c FROM so GROUP BY 1)
  SELECT so.clip_id, so.sample_index, k < c AS stripped FROM so JOIN ct USING (clip_id)""")  # fmt: skip
def strip_keyframes(spark, sf_dir):
    got = keyframes.strip_keyframes(keyframes.stripping_order(_proxy(spark, sf_dir)), 0.1, 3.5)
    return got.select("clip_id", "sample_index", "stripped")


_TIER = """ta AS (SELECT *, max(error) OVER (PARTITION BY clip_id ORDER BY error, segment_index DESC, position) AS m FROM ps WHERE movable),
  tr AS (SELECT *, row_number() OVER (ORDER BY m, clip_id, segment_index DESC, position) AS k FROM ta), tc AS (SELECT count(*) AS n, count(*) FILTER (movable) AS mv FROM ps),
  tl AS (SELECT least(mv, CAST(floor({low} * n) AS BIGINT)) AS lo, n, mv FROM tc), tm AS (SELECT lo, least(mv - lo, CAST(floor({medium} * n) AS BIGINT)) AS md FROM tl),
  td AS (SELECT clip_id, segment_index, sample_index, CASE WHEN k <= lo THEN 'low' WHEN k <= lo + md THEN 'medium' ELSE 'high' END AS tier FROM tr, tm UNION ALL SELECT clip_id, segment_index, sample_index, 'high' FROM ps WHERE NOT movable)"""


def _assigned(spark, sf_dir, medium: float, low: float) -> DataFrame:
    return tiers.assign_tiers(_proxy(spark, sf_dir), DatabaseSettings(medium_importance_tier_proportion=medium, low_importance_tier_proportion=low))


for _name, _medium, _low in (("tier_assignment", 0.0, 0.5), ("tier_assignment_mixed", 0.3, 0.4)):
    add(_name, f"WITH {_PROXY}, {_TIER.format(low=f'{_low}::DOUBLE', medium=f'{_medium}::DOUBLE')} SELECT * FROM td")(
        lambda spark, sf_dir, m=_medium, lo=_low: _assigned(spark, sf_dir, m, lo).select("clip_id", "segment_index", "sample_index", "tier")
    )


@add("tier_masks", f"WITH {_PROXY}, {_TIER.format(low='0.4::DOUBLE', medium='0.3::DOUBLE')} SELECT td.clip_id, td.segment_index, tier, CAST(sum(1::BIGINT << CAST(31 - (sample_index - s0) AS INT)) AS BIGINT) AS mask FROM td JOIN segs ON segs.clip_id = td.clip_id AND segs.sg = td.segment_index GROUP BY ALL")
def tier_masks(spark, sf_dir):
    return tiers.sample_masks(_assigned(spark, sf_dir, 0.3, 0.4), segments.segment_table(clips_of(spark, sf_dir)))


@add("tier_stripped", f"WITH {_PROXY}, {_TIER.format(low='0.4::DOUBLE', medium='0.3::DOUBLE')} SELECT tier, count(*) AS n FROM td WHERE tier <> 'low' GROUP BY 1")
def tier_stripped(spark, sf_dir):
    return tiers.strip_tier(_assigned(spark, sf_dir, 0.3, 0.4), "low").groupBy("tier").agg(F.count("*").alias("n"))


def _chunks(spark, sf_dir) -> DataFrame:
    frames = _assigned(spark, sf_dir, 0.3, 0.4).where("tier <> 'high'")
    sizes = frames.groupBy("tier", "clip_id", "segment_index").agg((F.count("*") * 64 * 2).alias("bytes"))
    return tiers.chunk_layout(sizes, 4096)


add("chunk_layout")(_chunks)
add("database_stats")(lambda spark, sf_dir: tiers.database_stats(_chunks(spark, sf_dir)))


@add("clips_in_database", "SELECT DISTINCT CAST(label AS BIGINT) AS clip_id FROM embeddings WHERE label % 2 = 0")
def clips_in_database(spark, sf_dir):
    hashes = tiers.clip_hashes(views.embedding_tracks(spark, sf_dir))
    return tiers.contains(hashes.where("clip_id % 2 = 0"), hashes).select("clip_id")


# --- transform compression --------------------------------------------------------------------


@add("contributing_error")
def contributing_error(spark, sf_dir):
    return keyframes.contributing_error(segmented(poses_of(spark, sf_dir)))


@add("strip_transform_keyframes")
def strip_transform(spark, sf_dir):
    ordered = keyframes.stripping_order(keyframes.contributing_error(segmented(poses_of(spark, sf_dir))))
    return keyframes.strip_keyframes(ordered, 0.0, 5.0)


@add("transform_bit_rates")
def transform_bit_rates(spark, sf_dir):
    df, classes = _classes(spark, sf_dir)
    return transform.bit_rates(segmented(df), classes, 0.05)


@add("compress_roundtrip_error")
def compress_roundtrip(spark, sf_dir):
    df, classes = _classes(spark, sf_dir)
    split = segmented(df)
    lossy = transform.compress_poses(split, classes, 0.05)
    found = ps.pose_errors(ps.to_object_space(df), ps.to_object_space(lossy.drop("segment_index")))
    return ps.worst_pose_error(found, views.RATE)
