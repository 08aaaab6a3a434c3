"""Queries over transform clips and the SQL that states the same.

The SQL spells the algebra out component by component; every step is a common table expression
so that no expression is nested twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.functions import packing, qvv
from tracksmith.functions import timeline as tl
from tracksmith.operators import poses as ps
from tracksmith.operators import sampling
from tracksmith.plans.track_queries import FRAMES, Query
from tracksmith.sources import views

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BONES, SHELL = 6, 3.0


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- SQL of the algebra -----------------------------------------------------------------------


def sq_mul(a: str, b: str) -> str:
    return (
        f"[{b}[4]*{a}[1] + {b}[1]*{a}[4] + {b}[2]*{a}[3] - {b}[3]*{a}[2], {b}[4]*{a}[2] - {b}[1]*{a}[3] + {b}[2]*{a}[4] + {b}[3]*{a}[1], "
        f"{b}[4]*{a}[3] + {b}[1]*{a}[2] - {b}[2]*{a}[1] + {b}[3]*{a}[4], {b}[4]*{a}[4] - {b}[1]*{a}[1] - {b}[2]*{a}[2] - {b}[3]*{a}[3]]"
    )


def s_conj(q: str) -> str:
    return f"[-{q}[1], -{q}[2], -{q}[3], {q}[4]]"


def s_norm(q: str) -> str:
    n = f"sqrt({q}[1]*{q}[1] + {q}[2]*{q}[2] + {q}[3]*{q}[3] + {q}[4]*{q}[4])"
    return f"[{q}[1]/{n}, {q}[2]/{n}, {q}[3]/{n}, {q}[4]/{n}]"


def s_rot(v: tuple[str, str, str], q: str) -> list[str]:
    x, y, z = v
    tx, ty, tz = (f"(2.0 * ({q}[2]*({z}) - {q}[3]*({y})))", f"(2.0 * ({q}[3]*({x}) - {q}[1]*({z})))", f"(2.0 * ({q}[1]*({y}) - {q}[2]*({x})))")
    return [f"(({x}) + {q}[4]*{tx} + ({q}[2]*{tz} - {q}[3]*{ty}))", f"(({y}) + {q}[4]*{ty} + ({q}[3]*{tx} - {q}[1]*{tz}))", f"(({z}) + {q}[4]*{tz} + ({q}[1]*{ty} - {q}[2]*{tx}))"]


def s_mul(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[str, str, str]:
    """(q, t, s) of the product; operands are column names."""
    aq, at, as_ = a
    bq, bt, bs = b
    r = s_rot(tuple(f"{at}[{i}]*{bs}[{i}]" for i in (1, 2, 3)), bq)
    return sq_mul(aq, bq), "[" + ", ".join(f"{r[i]} + {bt}[{i + 1}]" for i in range(3)) + "]", f"[{as_}[1]*{bs}[1], {as_}[2]*{bs}[2], {as_}[3]*{bs}[3]]"


def s_inv(a: tuple[str, str, str]) -> tuple[str, str, str]:
    q, t, s = a
    conj = s_conj(q)
    r = s_rot(tuple(f"{t}[{i}]*(1.0/{s}[{i}])" for i in (1, 2, 3)), "cj")
    return conj, "[" + ", ".join(f"-{x}" for x in r) + "]", f"[1.0/{s}[1], 1.0/{s}[2], 1.0/{s}[3]]"


def s_point(axis: int, d: str, x: tuple[str, str, str]) -> list[str]:
    q, t, s = x
    p = tuple(f"{d}*{s}[{i}]" if i == axis else "0.0::DOUBLE" for i in (1, 2, 3))
    r = s_rot(p, q)
    return [f"({r[i]} + {t}[{i + 1}])" for i in range(3)]


def s_error(a: tuple[str, str, str], b: tuple[str, str, str], d: str) -> str:
    out = []
    for axis in (1, 2, 3):
        p, r = s_point(axis, d, a), s_point(axis, d, b)
        out.append("sqrt(" + " + ".join(f"pow({x} - {y}, 2)" for x, y in zip(p, r, strict=True)) + ")")
    return f"greatest({', '.join(out)})"


POSES = FRAMES + """, e AS (SELECT clip_id, CAST(sample_index AS INT) AS sample_index, CAST(b AS INT) AS bone, CASE WHEN b > 0 THEN CAST((b - 1) // 2 AS INT) END AS parent,
  list_transform(embedding[b * 10 + 1 : b * 10 + 10], lambda x: CAST(x AS DOUBLE)) AS f FROM frames, range(6) r(b)),
  en AS (SELECT *, sqrt(f[1]*f[1] + f[2]*f[2] + f[3]*f[3] + f[4]*f[4]) AS n FROM e),
  p AS (SELECT clip_id, sample_index, bone, parent, CASE WHEN n < 1e-9 THEN [0.0, 0.0, 0.0, 1.0] ELSE [f[1]/n, f[2]/n, f[3]/n, f[4]/n] END AS q,
    [f[5]*100.0, f[6]*100.0, f[7]*100.0] AS t, [1.0 + 0.1::DOUBLE*f[8], 1.0 + 0.1::DOUBLE*f[9], 1.0 + 0.1::DOUBLE*f[10]] AS s FROM en)"""

_LQ, _LT, _LS = s_mul(("p.q", "p.t", "p.s"), ("o.q", "o.t", "o.s"))
OBJECT = f"""o AS (SELECT clip_id, sample_index, bone, q, t, s FROM p WHERE parent IS NULL
  UNION ALL SELECT clip_id, sample_index, bone, {s_norm("q")} AS q, t, s FROM (SELECT p.clip_id, p.sample_index, p.bone, {_LQ} AS q, {_LT} AS t, {_LS} AS s
  FROM p JOIN o ON o.clip_id = p.clip_id AND o.sample_index = p.sample_index AND o.bone = p.parent))"""
# one more frame of samples moved by 2 %, as a lossy stand-in
LOSSY = "ly AS (SELECT clip_id, sample_index, bone, parent, q, [t[1] + 0.02::DOUBLE, t[2] - 0.01::DOUBLE * bone, t[3]] AS t, [s[1], s[2] * 1.001::DOUBLE, s[3]] AS s FROM p)"


def out(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Components as rounded columns."""
    parts = [(F.round(F.col(c).getItem(i), digits) + 0.0).alias(f"{c}{i}")  # + 0.0: no negative zero
             for c, n in (("q", 4), ("t", 3), ("s", 3)) if c in df.columns for i in range(n)]
    return df.select(*keys, *parts)


def s_out(keys: str, source: str, names: str = "qts") -> str:
    cols = [f"round({c}[{i + 1}], 6) + 0.0::DOUBLE AS {c}{i}" for c, n in (("q", 4), ("t", 3), ("s", 3)) if c in names for i in range(n)]
    return f"SELECT {keys}, {', '.join(cols)} FROM {source}"


K = "clip_id, sample_index, bone"
KEYS = ["clip_id", "sample_index", "bone"]


def poses_of(spark, sf_dir) -> DataFrame:
    return views.embedding_poses(spark, sf_dir, BONES)


def lossy_of(df: DataFrame) -> DataFrame:
    t, s = F.col("t"), F.col("s")
    return df.withColumn("t", F.array(t.getItem(0) + 0.02, t.getItem(1) - 0.01 * F.col("bone"), t.getItem(2))).withColumn("s", F.array(s.getItem(0), s.getItem(1) * 1.001, s.getItem(2)))


# --- queries ----------------------------------------------------------------------------------


@add("pose_view", f"WITH {POSES} " + s_out(K, "p"))
def pose_view(spark, sf_dir):
    return out(poses_of(spark, sf_dir), KEYS)


@add("ensure_w_positive", f"WITH {POSES}, w AS (SELECT {K}, CASE WHEN q[4] < 0 THEN [-q[1], -q[2], -q[3], -q[4]] ELSE q END AS q FROM p) " + s_out(K, "w", "q"))
def ensure_w_positive(spark, sf_dir):
    return out(poses_of(spark, sf_dir).select(*KEYS, qvv.q_positive_w(F.col("q")).alias("q")), KEYS)


@add("normalize_rotations", f"WITH {POSES}, d AS (SELECT {K}, list_transform(q, lambda x: x * (1.0 + bone)) AS q FROM p), w AS (SELECT {K}, {s_norm('q')} AS q FROM d) " + s_out(K, "w", "q"))
def normalize_rotations(spark, sf_dir):
    scaled = poses_of(spark, sf_dir).select(*KEYS, F.transform("q", lambda x: x * (1.0 + F.col("bone"))).alias("q"))
    return out(scaled.withColumn("q", qvv.q_normalize(F.col("q"))), KEYS)


@add("drop_w_reconstruct", f"WITH {POSES}, w AS (SELECT {K}, CASE WHEN q[4] < 0 THEN [-q[1], -q[2], -q[3], -q[4]] ELSE q END AS q FROM p), x AS (SELECT {K}, [q[1], q[2], q[3], sqrt(abs(1.0 - q[1]*q[1] - q[2]*q[2] - q[3]*q[3]))] AS q FROM w) " + s_out(K, "x", "q"))
def drop_w(spark, sf_dir):
    return out(poses_of(spark, sf_dir).select(*KEYS, qvv.q_with_w(qvv.q_positive_w(F.col("q"))).alias("q")), KEYS)


@add("quaternion_pack", f"""WITH {POSES}, w AS (SELECT {K}, CASE WHEN q[4] < 0 THEN [-q[1], -q[2], -q[3]] ELSE q[1:3] END AS v FROM p)
  SELECT {K}, CAST(round((v[1] * 0.5 + 0.5) * 65535) AS BIGINT) AS x, CAST(round((v[2] * 0.5 + 0.5) * 65535) AS BIGINT) AS y, CAST(round((v[3] * 0.5 + 0.5) * 65535) AS BIGINT) AS z FROM w""")
def quaternion_pack(spark, sf_dir):
    codes = packing.pack_quaternion(F.col("q"), 16)
    return poses_of(spark, sf_dir).select(*KEYS, *[codes.getItem(i).alias(n) for i, n in enumerate("xyz")])


@add("pose_lerp", f"""WITH {POSES}, c AS (SELECT clip_id, max(sample_index) + 1 AS n, max(sample_index) / 30.0::DOUBLE AS d FROM p GROUP BY 1),
  g AS (SELECT clip_id, n, CAST(i AS INT) AS request_id, i * d / 24 * 30.0::DOUBLE AS x FROM c, range(25) r(i)),
  k AS (SELECT *, least(CAST(floor(x) AS INT), n - 1) AS k0 FROM g), k1 AS (SELECT *, least(k0 + 1, n - 1) AS k1, CASE WHEN k0 >= n - 1 THEN 0.0 ELSE x - k0 END AS a FROM k),
  j AS (SELECT k1.clip_id, request_id, u.bone, a, u.q AS q0, u.t AS t0, u.s AS s0, w.q AS q1, w.t AS t1, w.s AS s1,
        CASE WHEN u.q[1]*w.q[1] + u.q[2]*w.q[2] + u.q[3]*w.q[3] + u.q[4]*w.q[4] < 0 THEN -1.0 ELSE 1.0 END AS sg
        FROM k1 JOIN p u ON u.clip_id = k1.clip_id AND u.sample_index = k0 JOIN p w ON w.clip_id = k1.clip_id AND w.sample_index = k1.k1 AND w.bone = u.bone),
  l AS (SELECT clip_id, request_id, bone, [{", ".join(f"(q0[{i}] - a*q0[{i}]) + a*(q1[{i}]*sg)" for i in (1, 2, 3, 4))}] AS q, [{", ".join(f"(t0[{i}] - a*t0[{i}]) + a*t1[{i}]" for i in (1, 2, 3))}] AS t,
        [{", ".join(f"(s0[{i}] - a*s0[{i}]) + a*s1[{i}]" for i in (1, 2, 3))}] AS s FROM j), z AS (SELECT clip_id, request_id, bone, {s_norm("q")} AS q, t, s FROM l) """ + s_out("clip_id, request_id, bone", "z"))  # fmt: skip
def pose_lerp(spark, sf_dir):
    df = poses_of(spark, sf_dir)
    clips = df.groupBy("clip_id").agg((F.max("sample_index") + 1).alias("num_samples")).withColumn("sample_rate", F.lit(views.RATE))
    clips = clips.withColumn("finite_duration", tl.finite_duration(F.col("num_samples"), F.col("sample_rate")))
    sought = sampling.seek(sampling.time_grid(clips, 25)).select("clip_id", "request_id", "key0", "key1", "alpha")
    return out(ps.sample_poses(df, sought), ["clip_id", "request_id", "bone"])


@add("local_to_object", f"WITH RECURSIVE {POSES}, {OBJECT} " + s_out(K, "o"))
def local_to_object(spark, sf_dir):
    return out(ps.to_object_space(poses_of(spark, sf_dir)), KEYS)


_IQ, _IT, _IS = s_inv(("q", "t", "s"))
_PI = f"pi AS (SELECT {K}, {_IQ} AS q, {_IT} AS t, {_IS} AS s FROM (SELECT *, {s_conj('q')} AS cj FROM p))"
_M = s_mul(("p.q", "p.t", "p.s"), ("pi.q", "pi.t", "pi.s"))
_MF = s_mul(("pi.q", "pi.t", "pi.s"), ("p.q", "p.t", "p.s"))
for _first, _name, _m in ((False, "object_to_local", _M), (True, "object_to_local_parent_first", _MF)):
    add(
        _name,
        f"""WITH {POSES}, {_PI}, m AS (SELECT p.clip_id, p.sample_index, p.bone, {_m[0]} AS q, {_m[1]} AS t, {_m[2]} AS s FROM p JOIN pi ON pi.clip_id = p.clip_id AND pi.sample_index = p.sample_index AND pi.bone = p.parent),
        z AS (SELECT {K}, {s_norm("q")} AS q, t, s FROM m UNION ALL SELECT {K}, q, t, s FROM p WHERE parent IS NULL) """ + s_out(K, "z"),
    )(lambda spark, sf_dir, f=_first: out(ps.to_local_space(poses_of(spark, sf_dir), f), KEYS))


@add("bone_depth_chain", """WITH RECURSIVE b AS (SELECT DISTINCT CAST(label AS BIGINT) AS clip_id, CAST(i AS INT) AS bone, CASE WHEN i > 0 THEN CAST((i - 1) // 2 AS INT) END AS parent FROM embeddings, range(6) r(i)),
  w AS (SELECT clip_id, bone, 0 AS depth, CAST(bone AS VARCHAR) AS chain FROM b WHERE parent IS NULL UNION ALL SELECT b.clip_id, b.bone, w.depth + 1, w.chain || '>' || b.bone FROM w JOIN b ON b.clip_id = w.clip_id AND b.parent = w.bone)
  SELECT clip_id, bone, depth, chain, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY depth, bone) - 1 AS INT) AS position FROM w""")  # fmt: skip
def bone_depth_chain(spark, sf_dir):
    bones = poses_of(spark, sf_dir).select("clip_id", "bone", "parent").distinct()
    return ps.parent_first_order(bones).select("clip_id", "bone", "depth", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"), F.col("order").alias("position"))


@add("automatic_level", "SELECT DISTINCT CAST(label AS BIGINT) AS clip_id, 3 AS longest, 'highest' AS level FROM embeddings")
def automatic_level(spark, sf_dir):
    return ps.automatic_level(poses_of(spark, sf_dir).select("clip_id", "bone", "parent").distinct())


_BASE = f"bs AS (SELECT clip_id, bone, q, t, s, cj, {_IQ} AS iq, {_IT} AS it, {_IS} AS isc FROM (SELECT *, {s_conj('q')} AS cj FROM p WHERE sample_index = 0))"
_REL = s_mul(("p.q", "p.t", "p.s"), ("bs.iq", "bs.it", "bs.isc"))
_ADD_T = "[p.t[1] - bs.t[1], p.t[2] - bs.t[2], p.t[3] - bs.t[3]]"
_ADDITIVE = {
    "relative": _REL,
    "additive0": (sq_mul("p.q", "bs.cj"), _ADD_T, "[p.s[1]*(1.0/bs.s[1]), p.s[2]*(1.0/bs.s[2]), p.s[3]*(1.0/bs.s[3])]"),
    "additive1": (sq_mul("p.q", "bs.cj"), _ADD_T, "[p.s[1]*(1.0/bs.s[1]) - 1.0, p.s[2]*(1.0/bs.s[2]) - 1.0, p.s[3]*(1.0/bs.s[3]) - 1.0]"),
}


def _based(spark, sf_dir) -> DataFrame:
    df = poses_of(spark, sf_dir)
    base = df.where("sample_index = 0").select("clip_id", "bone", ps.transform().alias("base"))
    return df.select(*KEYS, ps.transform().alias("x")).join(base, ["clip_id", "bone"])


for _kind, (_q, _t, _s) in _ADDITIVE.items():
    add(f"additive_{_kind}", f"WITH {POSES}, {_BASE}, z AS (SELECT p.clip_id, p.sample_index, p.bone, {_q} AS q, {_t} AS t, {_s} AS s FROM p JOIN bs ON bs.clip_id = p.clip_id AND bs.bone = p.bone) " + s_out(K, "z"))(
        lambda spark, sf_dir, k=_kind: out(_based(spark, sf_dir).withColumn("y", qvv.to_additive(F.col("base"), F.col("x"), k)).select(*KEYS, "y.q", "y.t", "y.s"), KEYS)
    )
    # applying what was converted gives the rotation and translation back (scales too, where they are uniform or the clip is not relative)
    add(f"additive_{_kind}_roundtrip", f"WITH {POSES} SELECT {K}, " + ", ".join(f"round(q[{i + 1}], 5) + 0.0::DOUBLE AS q{i}" for i in range(4)) + " FROM p")(
        lambda spark, sf_dir, k=_kind: out(
            _based(spark, sf_dir).withColumn("y", qvv.apply_additive(F.col("base"), qvv.to_additive(F.col("base"), F.col("x"), k), k)).select(*KEYS, "y.q"), KEYS, 5
        )
    )

_E = s_error(("p.q", "p.t", "p.s"), ("ly.q", "ly.t", "ly.s"), "3.0::DOUBLE")
_ERR = f"er AS (SELECT p.clip_id, p.sample_index, p.bone, {_E} AS error FROM p JOIN ly ON ly.clip_id = p.clip_id AND ly.sample_index = p.sample_index AND ly.bone = p.bone)"
for _name, _metric in (("qvv_error", ps.QvvMetric()), ("matrix_error", ps.MatrixMetric())):
    add(_name, f"WITH {POSES}, {LOSSY}, {_ERR} SELECT {K}, round(error, 6) AS error FROM er")(
        lambda spark, sf_dir, m=_metric: ps.pose_errors(poses_of(spark, sf_dir), lossy_of(poses_of(spark, sf_dir)), SHELL, m).withColumn("error", F.round("error", 6))
    )

_LO = OBJECT.replace("o AS (", "lo AS (", 1).replace("FROM p ", "FROM ly p ").replace("JOIN o ON o.", "JOIN lo o ON o.")
_OE = s_error(("o.q", "o.t", "o.s"), ("lo.q", "lo.t", "lo.s"), "3.0::DOUBLE")


@add("worst_pose_error", f"""WITH RECURSIVE {POSES}, {LOSSY}, {OBJECT}, {_LO}, er AS (SELECT o.clip_id, o.sample_index, o.bone, round({_OE}, 6) AS error FROM o JOIN lo ON lo.clip_id = o.clip_id AND lo.sample_index = o.sample_index AND lo.bone = o.bone),
  r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY error DESC, sample_index, bone) AS k FROM er) SELECT clip_id, bone, error, round(sample_index / 30.0::DOUBLE, 6) AS time FROM r WHERE k = 1""")  # fmt: skip
def worst_pose_error(spark, sf_dir):
    raw = poses_of(spark, sf_dir)
    found = ps.pose_errors(ps.to_object_space(raw), ps.to_object_space(lossy_of(raw)), SHELL).withColumn("error", F.round("error", 6))
    return ps.worst_pose_error(found, views.RATE).withColumn("time", F.round("time", 6))


def _reach(d: str) -> str:
    return "greatest(" + ", ".join("sqrt(" + " + ".join(f"pow({x}, 2)" for x in s_point(a, d, ("p.q", "p.t", "p.s"))) + ")" for a in (1, 2, 3)) + ")"


def _level(below: str, name: str, parents: str) -> str:
    """Shells after the bones of one level have reached up to ``parents``."""
    return f"""r_{name} AS (SELECT p.clip_id, p.parent AS bone, p.bone AS child, max({_reach("h.shell")}) + max(h.pr) AS reach, max(h.pr) AS pr FROM p JOIN {below} h ON h.clip_id = p.clip_id AND h.bone = p.bone WHERE p.parent IN ({parents}) GROUP BY 1, 2, 3),
    b_{name} AS (SELECT clip_id, bone, max(reach) AS reach, arg_max(pr, reach) AS pr FROM r_{name} GROUP BY 1, 2),
    {name} AS (SELECT h.clip_id, h.bone, CASE WHEN b.reach > h.shell THEN b.reach ELSE h.shell END AS shell, CASE WHEN b.reach > h.shell THEN b.pr ELSE h.pr END AS pr FROM {below} h LEFT JOIN b_{name} b ON b.clip_id = h.clip_id AND b.bone = h.bone)"""


@add("dominant_shell", f"WITH {POSES}, h0 AS (SELECT DISTINCT clip_id, bone, 3.0::DOUBLE AS shell, 0.01::DOUBLE * (bone + 1) AS pr FROM p), {_level('h0', 'h1', '1, 2')}, {_level('h1', 'h2', '0')} SELECT clip_id, bone, round(shell, 6) AS shell, round(pr, 6) AS pr FROM h2")
def dominant_shell(spark, sf_dir):
    df = poses_of(spark, sf_dir)
    return _shells(df).select("clip_id", "bone", F.round("shell", 6).alias("shell"), F.round("precision", 6).alias("pr"))


def _shells(df: DataFrame) -> DataFrame:
    bones = ps.bone_chains(df.select("clip_id", "bone", "parent").distinct())
    meta = df.select("clip_id", "bone", "parent").distinct().join(bones.select("clip_id", "bone", "depth"), ["clip_id", "bone"])
    return ps.dominant_shells(df, meta.withColumns({"shell": F.lit(SHELL), "precision": 0.01 * (F.col("bone") + 1)}), 2)


def _still(df: DataFrame) -> DataFrame:
    """Bone 1 does not turn, bone 2 does not move, bones 3 and up have no scale, bone 4 stands at the origin."""
    first = df.where("sample_index = 0").select("clip_id", "bone", F.col("q").alias("q0"), F.col("t").alias("t0"))
    b = F.col("bone")
    met = df.join(first, ["clip_id", "bone"])
    return met.withColumns({"q": F.when(b == 1, F.col("q0")).otherwise(F.col("q")), "t": F.when(b == 2, F.col("t0")).when(b == 4, qvv.vec(0, 0, 0)).otherwise(F.col("t")), "s": F.when(b >= 3, qvv.vec(1, 1, 1)).otherwise(F.col("s"))}).drop("q0", "t0")


_STILL = """st AS (SELECT p.clip_id, p.sample_index, p.bone, p.parent, CASE WHEN p.bone = 1 THEN z.q ELSE p.q END AS q, CASE WHEN p.bone = 2 THEN z.t WHEN p.bone = 4 THEN [0.0, 0.0, 0.0] ELSE p.t END AS t,
  CASE WHEN p.bone >= 3 THEN [1.0, 1.0, 1.0] ELSE p.s END AS s FROM p JOIN p z ON z.clip_id = p.clip_id AND z.bone = p.bone AND z.sample_index = 0)"""
_X = ("a.q", "a.t", "a.s")
_SWAP = {"rotation": (("z.q", "a.t", "a.s"), ("[0.0, 0.0, 0.0, 1.0]", "a.t", "a.s")), "translation": (("a.q", "z.t", "a.s"), ("a.q", "[0.0, 0.0, 0.0]", "a.s")), "scale": (("a.q", "a.t", "z.s"), ("a.q", "a.t", "[1.0, 1.0, 1.0]"))}
_CLASSES = f"""ce AS (SELECT a.clip_id, a.bone, {", ".join(f"max({s_error(_X, c, '3.0::DOUBLE')}) AS {n}_c, max({s_error(_X, d, '3.0::DOUBLE')}) AS {n}_d" for n, (c, d) in _SWAP.items())}
  FROM st a JOIN st z ON z.clip_id = a.clip_id AND z.bone = a.bone AND z.sample_index = 0 GROUP BY 1, 2),
  cl AS ({" UNION ALL ".join(f"SELECT clip_id, bone, '{n}' AS sub_track, CASE WHEN {n}_c > 0.01 THEN 'animated' WHEN {n}_d > 0.01 THEN 'constant' ELSE 'default' END AS class FROM ce" for n in _SWAP)})"""


def _classes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = _still(poses_of(spark, sf_dir))
    shells = df.select("clip_id", "bone").distinct().withColumns({"shell": F.lit(SHELL), "precision": F.lit(0.01)})
    return df, ps.sub_track_classes(df, shells)


@add("constant_default_subtracks", f"WITH {POSES}, {_STILL}, {_CLASSES} SELECT * FROM cl")
def sub_tracks(spark, sf_dir):
    return _classes(spark, sf_dir)[1]


for _mode, _value in (("skipped", "NULL"), ("constant", "[1.0, 1.0, 1.0]"), ("variable", "[1.0 + st.bone, 2.0, 0.5::DOUBLE]"), ("legacy", "[1.0, 1.0, 1.0]")):
    add(
        f"default_fill_{_mode}",
        f"WITH {POSES}, {_STILL}, {_CLASSES}, z AS (SELECT st.clip_id, st.sample_index, st.bone, CASE WHEN class = 'default' THEN {_value} ELSE s END AS s FROM st JOIN cl ON cl.clip_id = st.clip_id AND cl.bone = st.bone AND cl.sub_track = 'scale') " + s_out(K, "z", "s"),
    )(lambda spark, sf_dir, m=_mode: out(ps.fill_defaults(*_classes(spark, sf_dir), m, defaults=_own_defaults(spark, sf_dir)).select(*KEYS, "s"), KEYS))


def _own_defaults(spark, sf_dir) -> DataFrame:
    return poses_of(spark, sf_dir).select("clip_id", "bone").distinct().withColumn("value", F.array(F.col("bone") + 1.0, F.lit(2.0), F.lit(0.5)))
