"""Queries over compressed transform clips, hashes and small pose helpers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.functions import hashing
from tracksmith.operators import pose_clips as pc
from tracksmith.operators import sampling
from tracksmith.plans.pose_queries import _CLASSES, _STILL, POSES, _classes, out, poses_of, s_norm, s_out
from tracksmith.plans.track_queries import Query, clips_of
from tracksmith.sources import views

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SUBS = "clip_id, bone, sub_track"


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _parts_sql(source: str) -> str:
    """The components of sub-tracks as columns v1, v2, v3."""
    w = f"pw AS (SELECT clip_id, sample_index, bone, CASE WHEN q[4] < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g, q, t, s FROM {source})"
    one = lambda name, v: f"SELECT clip_id, bone, '{name}' AS sub_track, sample_index, {', '.join(f'{v.format(i)} AS v{i}' for i in (1, 2, 3))} FROM pw"
    return f"{w}, pt AS MATERIALIZED ({one('rotation', 'q[{}]*g')} UNION ALL {one('translation', 't[{}]')} UNION ALL {one('scale', 's[{}]')})"


_RG = f"rg AS (SELECT {SUBS}, {', '.join(f'min(v{i}) AS lo{i}, max(v{i}) - min(v{i}) AS ext{i}' for i in (1, 2, 3))} FROM pt GROUP BY ALL)"
_X = ", ".join(f"CASE WHEN ext{i} < 1e-9 THEN 0.0 ELSE least(1.0, (v{i} - lo{i}) / ext{i}) END AS x{i}" for i in (1, 2, 3))
_NX = f"nx AS (SELECT {SUBS}, sample_index, {_X}, v1, v2, v3, lo1, lo2, lo3, ext1, ext2, ext3 FROM pt JOIN rg USING ({SUBS}))"


@add("sub_track_ranges", f"WITH {POSES}, {_parts_sql('p')}, {_RG} SELECT {SUBS}, {', '.join(f'round(lo{i}, 6) + 0.0 AS lo{i}, round(ext{i}, 6) AS ext{i}' for i in (1, 2, 3))} FROM rg")
def sub_track_ranges(spark, sf_dir):
    found = pc.ranges(pc.components(poses_of(spark, sf_dir)))
    return found.select(*pc.SUB, *[(F.round(F.col("lo").getItem(i), 6) + 0.0).alias(f"lo{i + 1}") for i in range(3)], *[F.round(F.col("ext").getItem(i), 6).alias(f"ext{i + 1}") for i in range(3)])


@add("pose_range_reduction", f"WITH {POSES}, {_parts_sql('p')}, {_RG}, {_NX} SELECT {SUBS}, sample_index, {', '.join(f'round(x{i}, 6) AS x{i}' for i in (1, 2, 3))} FROM nx")
def pose_range_reduction(spark, sf_dir):
    found = pc.range_reduction(pc.components(poses_of(spark, sf_dir)))
    return found.select(*pc.SUB, "sample_index", *[F.round(F.col("x").getItem(i), 6).alias(f"x{i + 1}") for i in range(3)])


def _bits(poses: DataFrame) -> DataFrame:
    """12 bits and one more a bone; rotations of bone 5 are kept raw."""
    names = F.explode(F.array(*[F.lit(n) for n in ("rotation", "translation", "scale")])).alias("sub_track")
    bits = F.when((F.col("bone") == 5) & (F.col("sub_track") == "rotation"), pc.RAW_BITS).otherwise(F.col("bone") + 12)
    return poses.where("sample_index = 0").select("clip_id", "bone", names).withColumn("bits", bits)


def compressed(spark, sf_dir) -> pc.CompressedPoses:
    poses, classes = _classes(spark, sf_dir)
    return pc.compress(poses, classes, _bits(poses), views.RATE)


def _packed(i: int) -> str:
    return f"CASE class WHEN 'default' THEN CASE WHEN sub_track = 'scale' THEN 1.0 ELSE 0.0 END WHEN 'constant' THEN f{i} ELSE CASE WHEN bits = 32 THEN v{i} ELSE round(x{i} * top) * (1.0 / top) * ext{i} + lo{i} END END AS d{i}"


#: Decoded samples (clip_id, bone, sample_index, q, t, s).
DECODED = f"""{POSES}, {_STILL}, {_CLASSES}, {_parts_sql('st')}, {_RG}, {_NX},
  ff AS (SELECT {SUBS}, v1 AS f1, v2 AS f2, v3 AS f3 FROM pt WHERE sample_index = 0),
  bt AS (SELECT {SUBS}, class, CASE WHEN bone = 5 AND sub_track = 'rotation' THEN 32 ELSE bone + 12 END AS bits, pow(2.0, CASE WHEN bone = 5 AND sub_track = 'rotation' THEN 32 ELSE bone + 12 END) - 1 AS top FROM cl),
  dc AS MATERIALIZED (SELECT {SUBS}, sample_index, {', '.join(_packed(i) for i in (1, 2, 3))} FROM nx JOIN bt USING ({SUBS}) JOIN ff USING ({SUBS})),
  dp AS MATERIALIZED (SELECT r.clip_id, r.bone, r.sample_index, [r.d1, r.d2, r.d3, sqrt(abs(1.0 - r.d1*r.d1 - r.d2*r.d2 - r.d3*r.d3))] AS q, [m.d1, m.d2, m.d3] AS t, [k.d1, k.d2, k.d3] AS s
    FROM dc r JOIN dc m USING (clip_id, bone, sample_index) JOIN dc k USING (clip_id, bone, sample_index) WHERE r.sub_track = 'rotation' AND m.sub_track = 'translation' AND k.sub_track = 'scale')"""


def _sampled_sql(alpha: str, where: str = "", wraps: bool = False) -> str:
    last = "0" if wraps else "n - 1"
    d = "n / 30.0::DOUBLE" if wraps else "(n - 1) / 30.0::DOUBLE"
    keys = (
        "CASE WHEN floor(x) > n - 1 THEN 0 ELSE CAST(floor(x) AS INT) END AS k0, CASE WHEN floor(x) >= n - 1 THEN 0 ELSE CAST(floor(x) AS INT) + 1 END AS k1, CASE WHEN floor(x) > n - 1 THEN 0.0 ELSE x - floor(x) END AS z"
        if wraps
        else f"least(CAST(floor(x) AS INT), {last}) AS k0, least(CAST(floor(x) AS INT) + 1, {last}) AS k1, CASE WHEN floor(x) >= {last} THEN 0.0 ELSE x - floor(x) END AS z"
    )
    return f"""WITH {DECODED}, c AS (SELECT clip_id, max(sample_index) + 1 AS n FROM dp GROUP BY 1), g AS (SELECT clip_id, n, CAST(i AS INT) AS request_id, i * ({d}) / 24 * 30.0::DOUBLE AS x FROM c, range(25) r(i)),
  k AS (SELECT clip_id, request_id, {keys} FROM g), ka AS (SELECT *, {alpha} AS a FROM k),
  j AS MATERIALIZED (SELECT ka.clip_id, request_id, u.bone, a, u.q AS q0, u.t AS t0, u.s AS s0, w.q AS q1, w.t AS t1, w.s AS s1, CASE WHEN u.q[1]*w.q[1] + u.q[2]*w.q[2] + u.q[3]*w.q[3] + u.q[4]*w.q[4] < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg
    FROM ka JOIN dp u ON u.clip_id = ka.clip_id AND u.sample_index = k0 JOIN dp w ON w.clip_id = ka.clip_id AND w.sample_index = ka.k1 AND w.bone = u.bone {where}),
  l AS MATERIALIZED (SELECT clip_id, request_id, bone, [{", ".join(f"(q0[{i}] - a*q0[{i}]) + a*(q1[{i}]*sg)" for i in (1, 2, 3, 4))}] AS q, [{", ".join(f"(t0[{i}] - a*t0[{i}]) + a*t1[{i}]" for i in (1, 2, 3))}] AS t,
    [{", ".join(f"(s0[{i}] - a*s0[{i}]) + a*s1[{i}]" for i in (1, 2, 3))}] AS s FROM j), z AS (SELECT clip_id, request_id, bone, {s_norm("q")} AS q, t, s FROM l) """ + s_out("clip_id, request_id, bone", "z", "qts").replace(", 6)", ", 5)")


def _requests(spark, sf_dir, wraps: bool = False) -> DataFrame:
    clips = clips_of(spark, sf_dir)
    if wraps:
        clips = clips.withColumn("finite_duration", F.col("num_samples") / F.col("sample_rate"))
    return sampling.time_grid(clips, 25)


_REQUEST = ["clip_id", "request_id", "bone"]
for _policy, _alpha in (("none", "z"), ("nearest", "floor(z + 0.5)")):
    add(f"decompress_pose_{_policy}", _sampled_sql(_alpha))(lambda spark, sf_dir, p=_policy: out(pc.decompress(compressed(spark, sf_dir), _requests(spark, sf_dir), p), _REQUEST, 5))


@add("decompress_bone", _sampled_sql("z", "AND u.bone = 3"))
def decompress_bone(spark, sf_dir):
    return out(pc.decompress(compressed(spark, sf_dir).only_bone(3), _requests(spark, sf_dir)), _REQUEST, 5)


@add("decompress_pose_wrapped", _sampled_sql("z", wraps=True))
def decompress_pose_wrapped(spark, sf_dir):
    """The looping policy of the request overrides the clip's."""
    return out(pc.decompress(compressed(spark, sf_dir), _requests(spark, sf_dir, True), wraps=True), _REQUEST, 5)


@add("trivial_defaults", "SELECT DISTINCT CAST(label AS BIGINT) AS clip_id, label % 2 = 0 AS trivial FROM embeddings")
def trivial_defaults(spark, sf_dir):
    """Odd clips have a bone that is moved by default."""
    poses = poses_of(spark, sf_dir).where("sample_index = 0")
    moved = (F.col("clip_id") % 2 == 1) & (F.col("bone") == 2)
    table = poses.select("clip_id", "bone", F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("q"), F.array(F.when(moved, 1.0).otherwise(0.0), F.lit(0.0), F.lit(0.0)).alias("t"), F.array(*[F.lit(1.0)] * 3).alias("s"))
    return pc.trivial_defaults(table)


_BYTES = "list_transform(range(1, strlen(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS HUGEINT))"


@add(
    "fnv_hashes",
    f"""WITH h AS (SELECT c_custkey, list_reduce(list_concat([2166136261::HUGEINT], {_BYTES}), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h32,
  list_reduce(list_concat([14695981039346656037::HUGEINT], {_BYTES}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h64 FROM customer)
  SELECT c_custkey, CAST(h32 AS BIGINT) AS h32, lower(lpad(hex(CAST(h64 AS UBIGINT)), 16, '0')) AS h64, CAST((xor(h32, 12345::HUGEINT) * 16777619) % 4294967296 AS BIGINT) AS combined FROM h""",
)
def fnv_hashes(spark, sf_dir):
    named = views.table(spark, sf_dir, "customer").select("c_custkey", hashing.hash32(F.col("c_name")).alias("h32"), hashing.hash64(F.col("c_name")).alias("h64"))
    return named.withColumn("combined", hashing.combine32(F.col("h32"), F.lit(12345).cast("long")))
