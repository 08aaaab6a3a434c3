"""Queries on compressed clips as tables and on pose pre-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.functions import qvv
from tracksmith.operators import poses as ps
from tracksmith.operators import sampling, scalar, segments, storage
from tracksmith.plans.pose_queries import _CLASSES, _STILL, K, KEYS, POSES, _based, _classes, lossy_of, out, poses_of, s_error, s_out
from tracksmith.plans.track_queries import _SEGS, GRID, PRECISION, T1, T1C, Query, _grid_sql, _quant_sql, _rates_sql, clips_of
from tracksmith.sources import views

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _compressed(spark, sf_dir, precision=PRECISION) -> storage.CompressedClips:
    return storage.compress(views.embedding_tracks(spark, sf_dir), precision, views.RATE)


def _requests(spark, sf_dir) -> DataFrame:
    return sampling.time_grid(clips_of(spark, sf_dir), GRID)


def _decoded_sql(alpha: str) -> str:
    """The grid query over decoded samples in place of raw ones."""
    decoded = f"{T1}, {_quant_sql(PRECISION)}"
    grid = _grid_sql(alpha).removeprefix(f"WITH {T1C}").replace("JOIN t1 x", "JOIN qd x").replace("JOIN t1 y", "JOIN qd y")
    clips = T1C.removeprefix(T1)
    return f"WITH {decoded}{clips}, qd AS (SELECT clip_id, track_index, sample_index, lossy AS v FROM qz){grid}"


@add("decompress_tracks", _decoded_sql("z"))
def decompress_tracks(spark, sf_dir):
    return storage.decompress(_compressed(spark, sf_dir), _requests(spark, sf_dir)).withColumn("v", F.round("v", 6))


@add("decompress_tracks_nearest", _decoded_sql("floor(z + 0.5)"))
def decompress_nearest(spark, sf_dir):
    return storage.decompress(_compressed(spark, sf_dir), _requests(spark, sf_dir), "nearest").withColumn("v", F.round("v", 6))


@add("decompress_single_track", "SELECT * FROM (" + _decoded_sql("z") + ") WHERE track_index = 5")
def decompress_single(spark, sf_dir):
    one = storage.only_track(_compressed(spark, sf_dir), 5)
    return storage.decompress(one, _requests(spark, sf_dir)).withColumn("v", F.round("v", 6))


@add("convert_roundtrip", f"WITH {T1} SELECT clip_id, track_index, sample_index, v FROM t1")
def convert_roundtrip(spark, sf_dir):
    """No error is allowed, so every track is kept raw and comes back to the last bit."""
    return storage.to_samples(_compressed(spark, sf_dir, -1.0))


@add("compressed_validity", "SELECT DISTINCT CAST(label AS BIGINT) AS clip_id, true AS is_valid FROM embeddings")
def compressed_validity(spark, sf_dir):
    return storage.validity(_compressed(spark, sf_dir))


@add("compressed_headers", f"WITH {T1C} SELECT clip_id, 10 AS version, n AS num_samples, 64 AS num_tracks, 30.0::DOUBLE AS sample_rate, 'clamp' AS looping FROM clips")
def compressed_headers(spark, sf_dir):
    return _compressed(spark, sf_dir).header.select("clip_id", "version", "num_samples", "num_tracks", "sample_rate", "looping")


@add("segment_summary", f"WITH {T1C}, {_rates_sql(PRECISION)}, {_SEGS}, b AS (SELECT clip_id, CAST(sum(CASE WHEN bit_rate = 24 THEN 32 ELSE bit_rate END) AS BIGINT) AS bits FROM rt GROUP BY 1) SELECT clip_id, sg AS segment_index, sz AS num_samples, bits AS bits_per_frame, CAST(ceil(bits * sz / 8.0) AS BIGINT) AS animated_bytes FROM segs JOIN b USING (clip_id)")
def segment_summary(spark, sf_dir):
    sizes = scalar.compressed_sizes(scalar.bit_rates(views.embedding_tracks(spark, sf_dir), PRECISION), clips_of(spark, sf_dir))
    table = segments.segment_table(clips_of(spark, sf_dir)).join(sizes.select("clip_id", "bits_per_frame"), "clip_id")
    return table.select("clip_id", "segment_index", F.col("size").alias("num_samples"), "bits_per_frame", F.ceil(F.col("bits_per_frame") * F.col("size") / 8).alias("animated_bytes"))


_LOOP = s_error(("a.q", "a.t", "a.s"), ("b.q", "b.t", "b.s"), "3.0::DOUBLE")


@add("pose_loop_detection", f"WITH {POSES}, n AS (SELECT clip_id, max(sample_index) AS m FROM p GROUP BY 1) SELECT clip_id, max(n.m) + 1 AS num_samples, max(n.m) > 0 AND bool_and({_LOOP} <= 28.0) AS loops FROM n JOIN p a USING (clip_id) JOIN p b USING (clip_id) WHERE a.sample_index = 0 AND b.sample_index = n.m AND a.bone = b.bone GROUP BY 1")
def pose_loop_detection(spark, sf_dir):
    df = poses_of(spark, sf_dir)
    shells = df.select("clip_id", "bone").distinct().withColumns({"shell": F.lit(3.0), "precision": F.lit(28.0)})
    return ps.pose_loops(df, shells)


_WIDE = "cw AS (SELECT clip_id, bone, max(class) FILTER (sub_track = 'rotation') AS r, max(class) FILTER (sub_track = 'translation') AS m, max(class) FILTER (sub_track = 'scale') AS k FROM cl GROUP BY 1, 2)"


@add(
    "sanitize_transform",
    f"""WITH {POSES}, {_STILL}, {_CLASSES}, {_WIDE}, z AS (SELECT st.clip_id, st.sample_index, st.bone, CASE r WHEN 'default' THEN [0.0, 0.0, 0.0, 1.0] WHEN 'constant' THEN f.q ELSE st.q END AS q,
    CASE m WHEN 'default' THEN [0.0, 0.0, 0.0] WHEN 'constant' THEN f.t ELSE st.t END AS t, CASE k WHEN 'default' THEN [1.0, 1.0, 1.0] WHEN 'constant' THEN f.s ELSE st.s END AS s
    FROM st JOIN st f ON f.clip_id = st.clip_id AND f.bone = st.bone AND f.sample_index = 0 JOIN cw ON cw.clip_id = st.clip_id AND cw.bone = st.bone) """ + s_out(K, "z"),
)
def sanitize_transform(spark, sf_dir):
    df, classes = _classes(spark, sf_dir)
    return out(ps.sanitize(df, classes), KEYS)


@add("clip_flags", f"WITH {POSES}, {_STILL}, {_CLASSES} SELECT clip_id, bool_or(sub_track = 'scale' AND class <> 'default') AS has_scale, count(*) FILTER (class = 'default') AS num_default, count(*) FILTER (class = 'constant') AS num_constant, count(*) FILTER (class = 'animated') AS num_animated, count(*) FILTER (class = 'constant') * 12 AS constant_bytes FROM cl GROUP BY 1")
def clip_flags(spark, sf_dir):
    return ps.clip_flags(_classes(spark, sf_dir)[1])


@add("additive_base_time", f"WITH {T1C} SELECT clip_id, CAST(i AS INT) AS request_id, round(i * d / 24 / d * 0.5, 9) AS base_time FROM clips, range(25) r(i)")
def additive_base_time(spark, sf_dir):
    grid = sampling.time_grid(clips_of(spark, sf_dir), 25)
    return grid.select("clip_id", "request_id", F.round(ps.base_time(F.col("time"), F.col("finite_duration"), 0.5), 9).alias("base_time"))


@add("additive_error")
def additive_error(spark, sf_dir):
    raw, lossy = _based(spark, sf_dir), lossy_of(poses_of(spark, sf_dir)).select(*KEYS, ps.transform().alias("y"))
    met = raw.join(lossy, KEYS)
    metric = ps.AdditiveMetric("additive0", F.col("base"))
    to = lambda c: qvv.to_additive(F.col("base"), F.col(c), "additive0")
    return met.select(*KEYS, F.round(metric.error(to("x"), to("y"), F.lit(3.0)), 6).alias("error"))
