"""Queries over scalar tracks and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions import packing
from tracksmith.functions import timeline as tl
from tracksmith.operators import sampling, scalar, segments
from tracksmith.sources import views

RATE = views.RATE
GRID = 100
PRECISION = 1e-3
WIDE = 0.9  # a precision at which some embedding tracks are constant and some clips loop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL of the views -------------------------------------------------------------------------

FRAMES = "frames AS (SELECT CAST(label AS BIGINT) AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_index, embedding FROM embeddings)"
T1 = FRAMES + ", t1 AS (SELECT clip_id, CAST(sample_index AS INT) AS sample_index, CAST(i AS INT) AS track_index, CAST(embedding[i + 1] AS DOUBLE) AS v FROM frames, range(64) r(i))"
CLIPS = ", clips AS (SELECT clip_id, CAST(max(sample_index) + 1 AS INT) AS n, 64 AS nt, 30.0::DOUBLE AS rate, CAST(max(sample_index) AS DOUBLE) / 30.0::DOUBLE AS d FROM t1 GROUP BY clip_id)"
T1C = T1 + CLIPS
PRICES = """m AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) * 12 + month(l_shipdate) AS m, avg(l_quantity) a, avg(l_extendedprice) b, avg(l_discount) c, avg(l_tax) d FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS clip_id, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY m) - 1 AS sample_index, [a, b, c, d] AS frame FROM m),
t1 AS (SELECT clip_id, CAST(sample_index AS INT) AS sample_index, CAST(i AS INT) AS track_index, frame[i + 1] AS v FROM f, range(4) r(i))"""


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Rounds for comparison: sums and square roots differ in the last digits between engines."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def clips_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.clip_info(views.embedding_tracks(spark, sf_dir), RATE)


# --- clips and time ---------------------------------------------------------------------------


@add("clip_info", f"WITH {T1C} SELECT clip_id, n AS num_samples, d AS duration, d AS finite_duration, CAST(n * 64 * 4 AS BIGINT) AS raw_bytes FROM clips")
def clip_info(spark, sf_dir):
    return clips_of(spark, sf_dir).select("clip_id", "num_samples", "duration", "finite_duration", "raw_bytes")


@add(
    "time_maths",
    """SELECT CAST(i AS INT) AS n, CASE WHEN i = 0 THEN 0.0 WHEN i = 1 THEN 'inf'::DOUBLE ELSE (i - 1) / 24.0::DOUBLE END AS duration,
       CASE WHEN i <= 1 THEN 0.0 ELSE (i - 1) / 24.0::DOUBLE END AS finite_duration,
       CASE WHEN i = 0 THEN 0.0 ELSE i / 24.0::DOUBLE END AS wrapped, CAST(i AS INT) AS back FROM range(0, 200) r(i)""",
)
def time_maths(spark, sf_dir):
    n = F.col("n")
    return spark.range(200).select(F.col("id").cast("int").alias("n")).select(
        "n", tl.duration(n, 24.0).alias("duration"), tl.finite_duration(n, 24.0).alias("finite_duration"), tl.finite_duration(n, 24.0, True).alias("wrapped"),
        tl.num_samples(tl.duration(n, 24.0), 24.0).alias("back"),
    )


def _grid_sql(alpha: str, wraps: bool = False, track_alpha: str = "a") -> str:
    last = "n" if wraps else "n - 1"
    key1 = "CASE WHEN k0 + 1 > n - 1 THEN 0 ELSE k0 + 1 END" if wraps else "least(k0 + 1, n - 1)"
    past = "CASE WHEN k > n - 1 THEN 0 ELSE k END" if wraps else "least(k, n - 1)"
    zero = "CASE WHEN k > n - 1 THEN 0.0 ELSE x - k0 END" if wraps else f"CASE WHEN k0 = {key1} THEN 0.0 ELSE x - k0 END"
    return f"""WITH {T1C}, q AS (SELECT clip_id, n, CAST(i AS INT) AS request_id, i * (CAST({last} AS DOUBLE) / 30.0::DOUBLE) / 99 * 30.0::DOUBLE AS x FROM clips, range({GRID}) r(i)),
    k AS (SELECT *, CAST(floor(x) AS INT) AS k FROM q), k0 AS (SELECT *, {past} AS k0 FROM k),
    k1 AS (SELECT *, {key1} AS k1, {zero} AS z FROM k0), s AS (SELECT *, {alpha} AS a FROM k1),
    j AS (SELECT s.clip_id, s.request_id, x.track_index, x.v AS v0, y.v AS v1, s.z, s.a FROM s
          JOIN t1 x ON x.clip_id = s.clip_id AND x.sample_index = s.k0 JOIN t1 y ON y.clip_id = s.clip_id AND y.sample_index = s.k1 AND y.track_index = x.track_index)
    SELECT clip_id, request_id, track_index, round((v0 - {track_alpha} * v0) + {track_alpha} * v1, 6) AS v FROM j"""


def _sampled(spark, sf_dir, policy: str, wraps: bool = False, track_policy=None) -> DataFrame:
    clips = clips_of(spark, sf_dir)
    if wraps:
        clips = clips.withColumn("finite_duration", tl.finite_duration(F.col("num_samples"), F.col("sample_rate"), True))
    sought = sampling.seek(sampling.time_grid(clips, GRID), policy, wraps).select("clip_id", "request_id", "key0", "key1", "alpha")
    return r6(sampling.sample(views.embedding_tracks(spark, sf_dir), sought, track_policy), "v")


_ALPHAS = {"none": "z", "floor": "CAST(0.0 AS DOUBLE)", "ceil": "CAST(1.0 AS DOUBLE)", "nearest": "floor(z + 0.5)"}
for _policy, _alpha in _ALPHAS.items():
    add(f"sample_{_policy}", _grid_sql(_alpha))(lambda spark, sf_dir, p=_policy: _sampled(spark, sf_dir, p))
add("sample_wrap", _grid_sql("z", wraps=True))(lambda spark, sf_dir: _sampled(spark, sf_dir, "none", wraps=True))


@add("sample_per_track_rounding", _grid_sql("z", track_alpha="(CASE track_index % 4 WHEN 0 THEN z WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE floor(z + 0.5) END)"))
def sample_per_track(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in _ALPHAS])
    return _sampled(spark, sf_dir, "per_track", track_policy=lambda t: names[t % 4])


@add("sample_single_track", "SELECT * FROM (" + _grid_sql("z") + ") WHERE track_index = 17")
def sample_single(spark, sf_dir):
    sought = sampling.seek(sampling.time_grid(clips_of(spark, sf_dir), GRID)).select("clip_id", "request_id", "key0", "key1", "alpha")
    return r6(sampling.sample(views.embedding_tracks(spark, sf_dir).where("track_index = 17"), sought), "v")


@add(
    "sample_clamped_times",
    f"""WITH {T1C} SELECT c.clip_id, r.request_id, t.track_index, round(t.v, 6) AS v FROM clips c, (VALUES (0, 0), (1, 1)) r(request_id, at_end)
        JOIN t1 t ON t.clip_id = c.clip_id AND t.sample_index = CASE WHEN at_end = 1 THEN c.n - 1 ELSE 0 END""",
)
def sample_clamped(spark, sf_dir):
    clips = clips_of(spark, sf_dir)
    times = F.array(F.lit(-1.0), F.col("finite_duration") + 5.0)
    requests = clips.select("*", F.posexplode(times).alias("request_id", "time"))
    return r6(sampling.sample(views.embedding_tracks(spark, sf_dir), sampling.seek(requests)), "v")


@add(
    "sample_float4",
    f"""WITH g AS ({_grid_sql("z")}) SELECT clip_id, request_id, CAST(track_index // 4 AS INT) AS track_index,
        max(v) FILTER (track_index % 4 = 0) AS x, max(v) FILTER (track_index % 4 = 1) AS y, max(v) FILTER (track_index % 4 = 2) AS z, max(v) FILTER (track_index % 4 = 3) AS w
        FROM g GROUP BY ALL""",
)
def sample_float4(spark, sf_dir):
    sought = sampling.seek(sampling.time_grid(clips_of(spark, sf_dir), GRID)).select("clip_id", "request_id", "key0", "key1", "alpha")
    got = sampling.sample(views.embedding_vectors(spark, sf_dir, 4), sought, width=4)
    return got.select("clip_id", "request_id", "track_index", *[F.round(F.col("v").getItem(i), 6).alias(n) for i, n in enumerate("xyzw")])


@add(
    "nearest_key",
    f"""WITH {T1C} SELECT k.clip_id, k.request_id, t.track_index, t.v AS v
        FROM (SELECT clip_id, CAST(i AS INT) AS request_id, least(CAST(floor(i * d / 99 * 30.0::DOUBLE + 0.5) AS INT), n - 1) AS s FROM clips, range({GRID}) r(i)) k
        JOIN t1 t ON t.clip_id = k.clip_id AND t.sample_index = k.s""",
)
def nearest_key(spark, sf_dir):
    grid = sampling.time_grid(clips_of(spark, sf_dir), GRID)
    keyed = grid.withColumn("sample_index", tl.nearest_key(F.col("num_samples"), F.col("sample_rate"), F.col("time")))
    return keyed.join(views.embedding_tracks(spark, sf_dir), ["clip_id", "sample_index"]).select("clip_id", "request_id", "track_index", "v")


_KEPT = "(k = s0 OR k = s0 + sz - 1 OR (k - s0) % 3 <> 1)"
_SEGS = """seg AS (SELECT clip_id, n, CASE WHEN n <= 31 THEN 1 WHEN n = 32 THEN 2 ELSE CAST(ceil(n / 16.0) AS INT) - 1 END AS ks FROM clips),
  segs AS (SELECT clip_id, n, CAST(i AS INT) AS sg, CAST(n // ks + (CASE WHEN i < n % ks THEN 1 ELSE 0 END) AS INT) AS sz,
           CAST(i * (n // ks) + least(i, n % ks) AS INT) AS s0 FROM seg, unnest(range(ks)) r(i))"""


@add(
    "sample_with_missing_frames",
    f"""WITH {T1C}, {_SEGS},
    f AS (SELECT clip_id, sg, s0, sz, CAST(k AS INT) AS k, {_KEPT} AS kept FROM segs, unnest(range(s0, s0 + sz)) r(k)),
    nb AS (SELECT clip_id, k, max(CASE WHEN kept THEN k END) OVER (PARTITION BY clip_id, sg ORDER BY k) AS b,
           min(CASE WHEN kept THEN k END) OVER (PARTITION BY clip_id, sg ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f),
    q AS (SELECT clip_id, n, CAST(i AS INT) AS request_id, i * d / 99 * 30.0::DOUBLE AS x FROM clips, range({GRID}) r(i)),
    s AS (SELECT clip_id, request_id, n, x, least(CAST(floor(x) AS INT), n - 1) AS k0, least(least(CAST(floor(x) AS INT), n - 1) + 1, n - 1) AS k1 FROM q),
    z AS (SELECT s.clip_id, request_id, k0 + (CASE WHEN k0 = k1 THEN 0.0 ELSE x - k0 END) AS idx, p.b AS k0, r.a AS k1 FROM s JOIN nb p ON p.clip_id = s.clip_id AND p.k = s.k0 JOIN nb r ON r.clip_id = s.clip_id AND r.k = s.k1),
    w AS (SELECT *, CASE WHEN k0 = k1 THEN 0.0 WHEN k0 < k1 THEN (idx - k0) / (k1 - k0) ELSE idx - k0 END AS al FROM z)
    SELECT w.clip_id, request_id, x.track_index, round((x.v - al * x.v) + al * y.v, 6) AS v FROM w JOIN t1 x ON x.clip_id = w.clip_id AND x.sample_index = w.k0
      JOIN t1 y ON y.clip_id = w.clip_id AND y.sample_index = w.k1 AND y.track_index = x.track_index""",
)
def sample_missing(spark, sf_dir):
    clips = clips_of(spark, sf_dir)
    table = segments.segment_table(clips).withColumn("sample_index", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    k = F.col("sample_index") - F.col("start")
    table = table.withColumn("kept", (k == 0) | (k == F.col("size") - 1) | (k % 3 != 1))
    sought = sampling.seek(sampling.time_grid(clips, GRID)).select("clip_id", "request_id", "key0", "key1", "alpha")
    moved = sampling.seek_retained(sought, sampling.retained_neighbours(table))
    return r6(sampling.sample(views.embedding_tracks(spark, sf_dir), moved), "v")


@add(
    "events_resample",
    """WITH d AS (SELECT CAST(user_id AS BIGINT) AS clip_id, CAST(day(ts) - 1 AS INT) AS sample_index, avg(value) AS v FROM events GROUP BY 1, 2),
    g AS (SELECT clip_id, CAST(i AS INT) AS sample_index FROM (SELECT DISTINCT clip_id FROM d), range(31) r(i)),
    m AS (SELECT g.*, d.v FROM g LEFT JOIN d USING (clip_id, sample_index))
    SELECT clip_id, sample_index, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY sample_index),
      first_value(v IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM m""",
)
def events_resample(spark, sf_dir):
    return r6(sampling.fill_gaps(views.event_tracks(spark, sf_dir), 31).select("clip_id", "sample_index", "v"), "v")


# --- scalar pipeline --------------------------------------------------------------------------

_RANGES = "rg AS (SELECT clip_id, track_index, min(v) AS lo, max(v) - min(v) AS ext FROM t1 GROUP BY 1, 2)"
_NORM = "nm AS (SELECT t.*, lo, ext, CASE WHEN ext < 1e-9 THEN 0.0 ELSE least(1.0, (v - lo) / ext) END AS x FROM t1 t JOIN rg USING (clip_id, track_index))"


def _rates_sql(precision: float) -> str:
    return f"""{_RANGES}, {_NORM},
    er AS (SELECT clip_id, track_index, b, max(abs((round(x * (pow(2.0, b) - 1)) * (1.0 / (pow(2.0, b) - 1)) * ext + lo) - v)) AS e FROM nm, range(1, 24) r(b) GROUP BY 1, 2, 3),
    rt AS (SELECT rg.clip_id, rg.track_index, rg.lo, rg.ext, abs(rg.ext) < {precision} AS is_constant,
           CASE WHEN abs(rg.ext) < {precision} THEN 0 ELSE coalesce((SELECT max(b) FROM er WHERE er.clip_id = rg.clip_id AND er.track_index = rg.track_index AND e > {precision}), 0) + 1 END AS bit_rate FROM rg)"""


def _quant_sql(precision: float) -> str:
    return f"""{_rates_sql(precision)},
    qz AS (SELECT nm.clip_id, nm.track_index, nm.sample_index, nm.v, rt.bit_rate, rt.is_constant,
           CASE WHEN NOT rt.is_constant AND rt.bit_rate < 24 THEN CAST(round(x * (pow(2.0, rt.bit_rate) - 1)) AS BIGINT) END AS code,
           CASE WHEN rt.is_constant THEN first_value(nm.v) OVER (PARTITION BY nm.clip_id, nm.track_index ORDER BY nm.sample_index) WHEN rt.bit_rate = 24 THEN nm.v
                ELSE round(x * (pow(2.0, rt.bit_rate) - 1)) * (1.0 / (pow(2.0, rt.bit_rate) - 1)) * rt.ext + rt.lo END AS lossy
           FROM nm JOIN rt USING (clip_id, track_index))"""


@add("track_ranges", f"WITH {T1}, {_RANGES} SELECT clip_id, track_index, lo AS v_min, ext AS v_ext FROM rg")
def track_ranges(spark, sf_dir):
    return scalar.ranges(views.embedding_tracks(spark, sf_dir))


@add("constant_tracks", f"WITH {T1}, {_RANGES} SELECT CAST(p AS INT) AS step, clip_id, track_index, abs(ext) < p / 10.0::DOUBLE AS is_constant FROM rg, range(1, 11) r(p)")
def constant_tracks(spark, sf_dir):
    found = scalar.ranges(views.embedding_tracks(spark, sf_dir)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return found.select("step", "clip_id", "track_index", (F.abs("v_ext") < F.col("step") / 10.0).alias("is_constant"))


@add("normalized_samples", f"WITH {T1}, {_RANGES}, {_NORM} SELECT clip_id, track_index, sample_index, round(x, 6) AS norm FROM nm WHERE NOT abs(ext) < {PRECISION}")
def normalized(spark, sf_dir):
    return r6(scalar.normalize(views.embedding_tracks(spark, sf_dir), PRECISION).select("clip_id", "track_index", "sample_index", "norm"), "norm")


@add("scalar_bit_rates", f"WITH {T1}, {_rates_sql(PRECISION)} SELECT clip_id, track_index, is_constant, CAST(bit_rate AS INT) AS bit_rate FROM rt")
def scalar_bit_rates(spark, sf_dir):
    return scalar.bit_rates(views.embedding_tracks(spark, sf_dir), PRECISION).drop("v_min", "v_ext")


def _quantized(spark, sf_dir, precision=PRECISION) -> DataFrame:
    tracks = views.embedding_tracks(spark, sf_dir)
    return scalar.quantize(tracks, scalar.bit_rates(tracks, precision))


@add("quantized_samples", f"WITH {T1}, {_quant_sql(PRECISION)} SELECT clip_id, track_index, sample_index, code FROM qz")
def quantized(spark, sf_dir):
    return _quantized(spark, sf_dir).select("clip_id", "track_index", "sample_index", "code")


@add("decayed_samples", f"WITH {T1}, {_quant_sql(PRECISION)} SELECT clip_id, track_index, sample_index, round(lossy, 6) AS lossy FROM qz")
def decayed(spark, sf_dir):
    return r6(_quantized(spark, sf_dir).select("clip_id", "track_index", "sample_index", "lossy"), "lossy")


_SIZES = """sz AS (SELECT clip_id, count(*) AS num_tracks, count(*) FILTER (is_constant) AS num_constant, count(*) FILTER (bit_rate > 0 AND bit_rate < 24) AS num_ranged,
    CAST(sum(CASE WHEN bit_rate = 24 THEN 32 ELSE bit_rate END) AS BIGINT) AS bits_per_frame FROM rt GROUP BY 1),
    cs AS (SELECT sz.*, n, CAST(n * num_tracks * 4 AS BIGINT) AS raw_bytes, CAST((num_tracks + 3) // 4 * 4 + num_constant * 4 + num_ranged * 8 + (CAST(ceil(bits_per_frame * n / 8.0) AS BIGINT) + 3) // 4 * 4 AS BIGINT) AS compressed_bytes
    FROM sz JOIN clips USING (clip_id))"""


@add("compressed_size", f"WITH {T1C}, {_rates_sql(PRECISION)}, {_SIZES} SELECT clip_id, bits_per_frame, compressed_bytes, round(raw_bytes / compressed_bytes, 6) AS ratio FROM cs")
def compressed_size(spark, sf_dir):
    rates = scalar.bit_rates(views.embedding_tracks(spark, sf_dir), PRECISION)
    return r6(scalar.compressed_sizes(rates, clips_of(spark, sf_dir)).select("clip_id", "bits_per_frame", "compressed_bytes", "ratio"), "ratio")


@add("bit_rate_histogram", f"WITH {T1}, {_rates_sql(PRECISION)} SELECT CAST(b AS INT) AS bit_rate, count(rt.bit_rate) AS n FROM range(25) r(b) LEFT JOIN rt ON rt.bit_rate = b GROUP BY 1")
def bit_rate_histogram(spark, sf_dir):
    rates = scalar.bit_rates(views.embedding_tracks(spark, sf_dir), PRECISION).groupBy("bit_rate").agg(F.count("*").alias("n"))
    return spark.range(25).select(F.col("id").cast("int").alias("bit_rate")).join(rates, "bit_rate", "left").fillna(0, ["n"])


@add("bit_rate_share_pct", f"WITH {T1}, {_rates_sql(1e-2)} SELECT clip_id, CAST(bit_rate AS INT) AS bit_rate, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY clip_id), 6) AS pct FROM rt GROUP BY 1, 2")
def bit_rate_share(spark, sf_dir):
    from pyspark.sql import Window

    n = scalar.bit_rates(views.embedding_tracks(spark, sf_dir), 1e-2).groupBy("clip_id", "bit_rate").agg(F.count("*").alias("n"))
    return n.select("clip_id", "bit_rate", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("clip_id")), 6).alias("pct"))


@add(
    "worst_scalar_error",
    f"""WITH {T1C}, {_quant_sql(PRECISION)}, w AS (SELECT clip_id, track_index, sample_index, abs(lossy - v) AS error FROM qz),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY error DESC, sample_index, track_index) AS k FROM w)
    SELECT clip_id, track_index, round(error, 9) AS error, round(least(sample_index / 30.0::DOUBLE, d), 6) AS time FROM r JOIN clips USING (clip_id) WHERE k = 1""",
)
def worst_scalar_error(spark, sf_dir):
    found = scalar.worst_error(scalar.errors(_quantized(spark, sf_dir)), RATE)
    return found.select("clip_id", "track_index", F.round("error", 9).alias("error"), F.round("time", 6).alias("time"))


@add("error_per_frame_and_track", f"WITH {T1}, {_quant_sql(PRECISION)} SELECT clip_id, track_index, sample_index, round(abs(lossy - v), 8) AS error FROM qz")
def error_matrix(spark, sf_dir):
    return scalar.errors(_quantized(spark, sf_dir)).withColumn("error", F.round("error", 8))


@add("loop_detection", f"""WITH {T1}, e AS (SELECT clip_id, track_index, arg_min(v, sample_index) AS a, arg_max(v, sample_index) AS b, count(*) AS n FROM t1 GROUP BY 1, 2)
    SELECT clip_id, max(n) AS num_samples, max(n) > 1 AND bool_and(abs(b - a) <= {WIDE}) AS loops FROM e GROUP BY 1""")  # fmt: skip
def loop_detection(spark, sf_dir):
    return scalar.loops(views.embedding_tracks(spark, sf_dir), WIDE)


_PRICE_LOOPS = "lp AS (SELECT clip_id, bool_and(abs(b - a) <= 2000.0) AND max(n) > 1 AS loops, max(n) AS n FROM (SELECT clip_id, track_index, arg_min(v, sample_index) AS a, arg_max(v, sample_index) AS b, count(*) AS n FROM t1 GROUP BY 1, 2) GROUP BY 1)"


@add("loop_trimmed", f"WITH {PRICES}, {_PRICE_LOOPS} SELECT clip_id, track_index, count(*) AS n, round(sum(v), 4) AS total FROM t1 JOIN lp USING (clip_id) WHERE NOT loops OR sample_index < lp.n - 1 GROUP BY 1, 2")
def loop_trimmed(spark, sf_dir):
    trimmed = scalar.trim_loops(views.price_tracks(spark, sf_dir), 2000.0)
    return trimmed.groupBy("clip_id", "track_index").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@add("loop_closed", f"""WITH {PRICES}, {_PRICE_LOOPS}, z AS (SELECT clip_id, track_index, v AS a FROM t1 WHERE sample_index = 0)
    SELECT clip_id, track_index, sample_index, round(CASE WHEN loops AND sample_index = lp.n - 1 THEN a ELSE v END, 6) AS v FROM t1 JOIN lp USING (clip_id) JOIN z USING (clip_id, track_index)""")  # fmt: skip
def loop_closed(spark, sf_dir):
    return r6(scalar.close_loops(views.price_tracks(spark, sf_dir), 2000.0).select("clip_id", "track_index", "sample_index", "v"), "v")


for _whole, _name in ((True, "sanitize_constant_scalar"), (False, "sanitize_constant_scalar_prepass")):
    _top = "max(v)" if _whole else "greatest(max(v) FILTER (sample_index > 0), arg_max(v, sample_index))"
    add(
        _name,
        f"""WITH {T1}, c AS (SELECT clip_id, track_index, arg_min(v, sample_index) AS a, {_top} - min(v) <= 0.42 AS flat FROM t1 GROUP BY 1, 2)
        SELECT clip_id, track_index, sample_index, CASE WHEN flat THEN a ELSE v END AS v FROM t1 JOIN c USING (clip_id, track_index)""",
    )(lambda spark, sf_dir, w=_whole: scalar.sanitize_constant(views.embedding_tracks(spark, sf_dir), 0.42, w).select("clip_id", "track_index", "sample_index", "v"))


@add("output_remap_strip", f"WITH {T1} SELECT clip_id, CAST((62 - track_index) // 2 AS INT) AS track_index, sample_index, v FROM t1 WHERE track_index % 2 = 0")
def output_remap(spark, sf_dir):
    t = F.col("track_index")
    mapping = spark.range(64).select(F.col("id").cast("int").alias("track_index")).withColumn("output_index", F.when(t % 2 == 0, ((62 - t) / 2).cast("int")))
    return scalar.remap_outputs(views.embedding_tracks(spark, sf_dir), mapping).select("clip_id", "track_index", "sample_index", "v")


@add("price_compress", f"""WITH {PRICES}, {_quant_sql(0.005)} SELECT clip_id, track_index, max(CAST(bit_rate AS INT)) AS bit_rate, bool_and(abs(lossy - v) <= 0.005 OR bit_rate = 0) AS within FROM qz GROUP BY 1, 2""")
def price_compress(spark, sf_dir):
    tracks = views.price_tracks(spark, sf_dir)
    q = scalar.quantize(tracks, scalar.bit_rates(tracks, 0.005))
    return q.groupBy("clip_id", "track_index").agg(F.max("bit_rate").alias("bit_rate"), F.bool_and((F.abs(F.col("lossy") - F.col("v")) <= 0.005) | (F.col("bit_rate") == 0)).alias("within"))


# --- segments ---------------------------------------------------------------------------------


@add(
    "segment_split",
    """WITH c AS (SELECT CAST(n AS INT) AS n, CASE WHEN n <= 31 THEN 1 WHEN n = 32 THEN 2 ELSE CAST(ceil(n / 16.0) AS INT) - 1 END AS k FROM range(1, 501) r(n))
    SELECT n, CAST(i AS INT) AS segment_index, CAST(n // k + (CASE WHEN i < n % k THEN 1 ELSE 0 END) AS INT) AS size FROM c, range(64) r(i) WHERE i < k""",
)
def segment_split(spark, sf_dir):
    n = spark.range(1, 501).select(F.col("id").cast("int").alias("n"))
    return n.select("n", F.posexplode(tl.segment_sizes(F.col("n"))).alias("segment_index", "size"))


_SEG_RANGES = f"""{_RANGES}, {_NORM}, {_SEGS}, sm AS (SELECT nm.*, sg FROM nm JOIN segs USING (clip_id) WHERE sample_index >= s0 AND sample_index < s0 + sz AND NOT abs(ext) < {PRECISION}),
    lh AS (SELECT clip_id, track_index, sg, min(x) AS l, max(x) AS h FROM sm GROUP BY 1, 2, 3),
    p1 AS (SELECT *, greatest(0.0, floor(l * 255.0::DOUBLE) / 255.0::DOUBLE) AS m FROM lh), p2 AS (SELECT *, ceil((h - m) * 255.0::DOUBLE) / 255.0::DOUBLE AS e FROM p1),
    pr AS (SELECT clip_id, track_index, sg, m, CASE WHEN e < h THEN least(1.0, e + 1.0::DOUBLE / 255.0::DOUBLE) ELSE e END AS e FROM p2)"""


@add("segment_ranges_padded", f"WITH {T1C}, {_SEG_RANGES} SELECT clip_id, track_index, sg AS segment_index, round(m, 6) AS s_min, round(e, 6) AS s_ext FROM pr")
def segment_ranges(spark, sf_dir):
    return r6(segments.segment_ranges(views.embedding_tracks(spark, sf_dir), clips_of(spark, sf_dir), PRECISION), "s_min", "s_ext")


@add(
    "segment_roundtrip",
    f"""WITH {T1C}, {_SEG_RANGES}, n2 AS (SELECT sm.*, m, e, CASE WHEN e < 1e-9 THEN 0.0 ELSE least(1.0, (x - m) / e) END AS y FROM sm JOIN pr USING (clip_id, track_index, sg))
    SELECT clip_id, track_index, sample_index, sg AS segment_index, round(y, 6) AS norm2, round((y * e + m) * ext + lo, 6) AS restored FROM n2""",
)
def segment_roundtrip(spark, sf_dir):
    got = segments.two_level(views.embedding_tracks(spark, sf_dir), clips_of(spark, sf_dir), PRECISION)
    return r6(got.select("clip_id", "track_index", "sample_index", "segment_index", "norm2", "restored"), "norm2", "restored")


# --- packing ----------------------------------------------------------------------------------


@add(
    "pack_formats",
    f"""WITH {T1}, b AS (SELECT * FROM (VALUES (8), (10), (11), (16), (19), (23)) r(bits))
    SELECT bits, track_index, sum(CAST(round(abs(v) * (pow(2.0, bits) - 1)) AS BIGINT))::BIGINT AS unsigned_codes, sum(CAST(round((v * 0.5 + 0.5) * (pow(2.0, bits) - 1)) AS BIGINT))::BIGINT AS signed_codes,
    round(max(abs(round(abs(v) * (pow(2.0, bits) - 1)) * (1.0 / (pow(2.0, bits) - 1)) - abs(v))), 9) AS unsigned_error FROM t1, b GROUP BY 1, 2""",
)
def pack_formats(spark, sf_dir):
    v, b = F.col("v"), F.col("bits")
    rows = views.embedding_tracks(spark, sf_dir).withColumn("bits", F.explode(F.array(*[F.lit(x) for x in (8, 10, 11, 16, 19, 23)])))
    return rows.groupBy("bits", "track_index").agg(
        F.sum(packing.pack_unsigned(F.abs(v), b)).alias("unsigned_codes"), F.sum(packing.pack_signed(v, b)).alias("signed_codes"),
        F.round(F.max(F.abs(packing.decay(F.abs(v), b) - F.abs(v))), 9).alias("unsigned_error"),
    )


@add(
    "bit_masks",
    """SELECT CAST(i AS BIGINT) AS mask, CAST(bit_count(i) AS INT) AS ones, CAST(CASE WHEN i = 0 THEN 32 ELSE 31 - floor(log2(i)) END AS INT) AS leading,
    CAST(CASE WHEN i = 0 THEN 32 ELSE bit_count((i & -i) - 1) END AS INT) AS trailing, CAST(i & ~85 AS BIGINT) AS without, CAST((i + 15) // 16 * 16 AS BIGINT) AS aligned,
    CAST(((i << 5) | (i >> 27)) & 4294967295 AS BIGINT) AS rotated FROM range(0, 5000) r(i)""",
)
def bit_masks(spark, sf_dir):
    m = F.col("mask")
    return spark.range(5000).select(F.col("id").alias("mask")).select(
        "mask", packing.count_bits(m).alias("ones"), packing.leading_zeros(m).alias("leading"), packing.trailing_zeros(m).alias("trailing"),
        packing.and_not(m, F.lit(85).cast("long")).alias("without"), packing.align_to(m, 16).alias("aligned"), packing.rotate_left(m, 5).alias("rotated"),
    )
