import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.functions import packing, qvv
from tracksmith.functions import timeline as tl
from tracksmith.operators import rigid

INF = float("inf")


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("duration,rate,n", [(0.0, 30.0, 0), (1.0, 30.0, 31), (1.0, 24.0, 25), (1 / 30, 30.0, 2), (INF, 30.0, 1)])
def test_num_samples(spark, duration, rate, n):
    assert one(spark, tl.num_samples(F.lit(duration), F.lit(rate)))[0] == n


@pytest.mark.parametrize("n,rate,duration,finite", [(0, 30.0, 0.0, 0.0), (1, 30.0, INF, 0.0), (1, 8.0, INF, 0.0), (31, 30.0, 1.0, 1.0), (9, 8.0, 1.0, 1.0)])
def test_durations(spark, n, rate, duration, finite):
    assert tuple(one(spark, tl.duration(F.lit(n), F.lit(rate)), tl.finite_duration(F.lit(n), F.lit(rate)))) == (duration, finite)


CASES = [
    (31, 30.0, 0.0, "none", False, 0, 1, 0.0),
    (31, 30.0, 1 / 30, "none", False, 1, 2, 0.0),
    (31, 30.0, 2.5 / 30, "none", False, 2, 3, 0.5),
    (31, 30.0, 1.0, "none", False, 30, 30, 0.0),
    (31, 30.0, 2.5 / 30, "floor", False, 2, 3, 0.0),
    (31, 30.0, 2.5 / 30, "ceil", False, 2, 3, 1.0),
    (31, 30.0, 2.4 / 30, "nearest", False, 2, 3, 0.0),
    (31, 30.0, 2.6 / 30, "nearest", False, 2, 3, 1.0),
    (1, 30.0, 0.0, "none", False, 0, 0, 0.0),
    (1, 30.0, 0.0, "ceil", False, 0, 0, 1.0),
    (30, 30.0, 29.5 / 30, "none", True, 29, 0, 0.5),
    (30, 30.0, 1.0, "none", True, 0, 0, 0.0),
]


@pytest.mark.parametrize("n,rate,t,policy,wraps,key0,key1,alpha", CASES)
def test_keyframes(spark, n, rate, t, policy, wraps, key0, key1, alpha):
    got = one(spark, tl.keyframes(F.lit(n), F.lit(rate), F.lit(t), policy, wraps))[0]
    assert got.key0 + got.alpha == pytest.approx(key0 + alpha, abs=1e-6)
    if alpha not in (0.0,):
        assert (got.key0, got.key1) == (key0, key1)


@pytest.mark.parametrize("n,sizes", [(0, []), (31, [31]), (32, [16, 16]), (35, [18, 17]), (39, [20, 19]), (48, [24, 24])])
def test_segments(spark, n, sizes):
    assert one(spark, tl.segment_sizes(F.lit(n)))[0] == sizes


def test_segments_cover_and_stay_small(spark):
    rows = spark.range(1, 2000).select("id", tl.segment_sizes(F.col("id").cast("int")).alias("s")).collect()
    assert all(sum(r.s) == r.id and max(r.s) <= 31 and max(r.s) - min(r.s) <= 1 for r in rows)


def test_alpha_between(spark):
    got = one(spark, tl.alpha_between(F.lit(2.5), 2, 4), tl.alpha_between(F.lit(2.5), 2, 4, "floor"), tl.alpha_between(F.lit(2.5), 3, 3, "ceil"), tl.alpha_between(F.lit(2.5), 3, 3))
    assert tuple(got) == (0.25, 0.0, 1.0, 0.0)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 19, 23])
def test_packing_a_code_gives_it_back(spark, bits):
    top = 2**bits - 1
    codes = sorted({0, 1, top, top // 2, *(random.Random(bits).randrange(top + 1) for _ in range(200))})
    df = spark.createDataFrame([(c,) for c in codes], "q long")
    for pack, unpack in ((packing.pack_unsigned, packing.unpack_unsigned), (packing.pack_signed, packing.unpack_signed)):
        assert df.where(pack(unpack(F.col("q"), bits), bits) != F.col("q")).count() == 0


def test_vector_formats_round_trip(spark):
    v = F.array(*[F.lit(x) for x in (0.1, 0.25, 0.9, 1.0)])
    for name, bits in packing.VECTOR_FORMATS.items():
        got = one(spark, packing.unpack_vector(packing.pack_vector(v, name), name))[0]
        assert np.allclose(got, [0.1, 0.25, 0.9, 1.0][: len(bits)], atol=1 / 2 ** min(bits))
    assert packing.packed_bytes("quatf_drop_w_48") == 6 and packing.packed_bytes("vector3_32") == 4


def pose(seed):
    r = np.random.default_rng(seed)
    q = r.normal(size=4)
    return [list(map(float, q / np.linalg.norm(q))), list(map(float, r.normal(size=3))), [float(abs(r.normal()) + 0.5)] * 3]


def column(p):
    return qvv.qvv(*[qvv.vec(*x) for x in p])


@pytest.mark.parametrize("seed", range(3))
def test_transform_algebra(spark, seed):
    a, b, c = (column(pose(seed * 10 + i)) for i in range(3))
    got = one(spark, qvv.mul(a, qvv.inverse(a)), qvv.mul(qvv.mul(a, b), c), qvv.mul(a, qvv.mul(b, c)), qvv.point(qvv.vec(1, 2, 3), qvv.mul(a, b)), qvv.point(qvv.point(qvv.vec(1, 2, 3), a), b))
    assert np.allclose(got[0].q, [0, 0, 0, 1], atol=1e-9) and np.allclose(got[0].t, 0, atol=1e-9) and np.allclose(got[0].s, 1)
    for part in "qts":
        assert np.allclose(got[1][part], got[2][part], atol=1e-9)
    assert np.allclose(got[3], got[4], atol=1e-9)


@pytest.mark.parametrize("kind", ["relative", "additive0", "additive1"])
def test_additive_round_trip(spark, kind):
    base, x = column(pose(1)), column(pose(2))
    got = one(spark, qvv.apply_additive(base, qvv.to_additive(base, x, kind), kind), x)
    for part in "qts":
        assert np.allclose(got[0][part], got[1][part], atol=1e-9)


def test_numpy_algebra_equals_columns(spark):
    p, r = pose(5), pose(6)
    got = one(spark, qvv.mul_normalized(column(p), column(r)), qvv.qvv_error(column(p), column(r), 3.0), qvv.matrix_error(qvv.to_matrix(column(p)), qvv.to_matrix(column(r)), 3.0))
    both = rigid.Pose(*[np.array([[r[k], p[k]]]) for k in range(3)])
    moved = rigid.to_object(both, [None, 0])
    for k, part in enumerate("qts"):
        assert np.allclose(moved[k][0, 1], got[0][part], atol=1e-9)
    error = rigid.error(rigid.Pose(*[np.array([[x]]) for x in p]), rigid.Pose(*[np.array([[x]]) for x in r]), 3.0)[0, 0]
    assert math.isclose(error, got[1], rel_tol=1e-9) and math.isclose(error, got[2], rel_tol=1e-9)
