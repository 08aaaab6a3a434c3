"""Algebra of rotation-translation-scale transforms on array Columns.

Quaternions are [x, y, z, w]; products apply the left operand first.
"""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY_Q = (0.0, 0.0, 0.0, 1.0)


def vec(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def bound(*names: str):
    """Evaluates the named Column arguments once a row, so that expressions do not grow with their use."""

    def wrap(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            given = inspect.signature(f).bind(*args, **kwargs)
            given.apply_defaults()
            values = F.array(F.struct(*[given.arguments[n].alias(n) for n in names]))

            def body(x: Column) -> Column:
                return f(**(given.arguments | {n: x[n] for n in names}))

            return F.transform(values, body).getItem(0)

        return call

    return wrap


def _g(a: Column, n: int) -> list[Column]:
    return [a.getItem(i) for i in range(n)]


@bound("a", "b")
def v_add(a: Column, b: Column) -> Column:
    return vec(*[x + y for x, y in zip(_g(a, 3), _g(b, 3), strict=True)])


@bound("a", "b")
def v_sub(a: Column, b: Column) -> Column:
    return vec(*[x - y for x, y in zip(_g(a, 3), _g(b, 3), strict=True)])


@bound("a", "b")
def v_mul(a: Column, b: Column) -> Column:
    return vec(*[x * y for x, y in zip(_g(a, 3), _g(b, 3), strict=True)])


@bound("a")
def v_scale(a: Column, k) -> Column:
    return vec(*[x * k for x in _g(a, 3)])


@bound("a")
def v_inv(a: Column) -> Column:
    """Component-wise reciprocal; 0 stays 0."""
    return vec(*[F.when(x == 0, 0.0).otherwise(1.0 / F.when(x == 0, 1.0).otherwise(x)) for x in _g(a, 3)])


@bound("a", "b")
def v_dist(a: Column, b: Column) -> Column:
    x, y, z = (p - q for p, q in zip(_g(a, 3), _g(b, 3), strict=True))
    return F.sqrt((x * x + y * y) + z * z)


@bound("a")
def v_len(a: Column) -> Column:
    x, y, z = _g(a, 3)
    return F.sqrt((x * x + y * y) + z * z)


@bound("a", "b")
def q_mul(a: Column, b: Column) -> Column:
    ax, ay, az, aw = _g(a, 4)
    bx, by, bz, bw = _g(b, 4)
    return vec(
        ((bw * ax + bx * aw) + by * az) - bz * ay,
        ((bw * ay - bx * az) + by * aw) + bz * ax,
        ((bw * az + bx * ay) - by * ax) + bz * aw,
        ((bw * aw - bx * ax) - by * ay) - bz * az,
    )


@bound("q")
def q_conj(q: Column) -> Column:
    x, y, z, w = _g(q, 4)
    return vec(-x, -y, -z, w)


@bound("v", "q")
def q_rotate(v: Column, q: Column) -> Column:
    vx, vy, vz = _g(v, 3)
    x, y, z, w = _g(q, 4)
    tx, ty, tz = 2.0 * (y * vz - z * vy), 2.0 * (z * vx - x * vz), 2.0 * (x * vy - y * vx)
    return vec((vx + w * tx) + (y * tz - z * ty), (vy + w * ty) + (z * tx - x * tz), (vz + w * tz) + (x * ty - y * tx))


@bound("q")
def q_normalize(q: Column) -> Column:
    x, y, z, w = _g(q, 4)
    n = F.sqrt(((x * x + y * y) + z * z) + w * w)
    return F.when(n < 1e-12, vec(*IDENTITY_Q)).otherwise(vec(*[c / F.when(n < 1e-12, 1.0).otherwise(n) for c in (x, y, z, w)]))


@bound("q")
def q_positive_w(q: Column) -> Column:
    x, y, z, w = _g(q, 4)
    return F.when(w < 0, vec(-x, -y, -z, -w)).otherwise(q)


@bound("q")
def q_with_w(q: Column) -> Column:
    x, y, z = _g(q, 3)
    return vec(x, y, z, F.sqrt(F.abs(((1.0 - x * x) - y * y) - z * z)))


@bound("a", "b")
def q_lerp(a: Column, b: Column, alpha, normalize: bool = True) -> Column:
    """The end is flipped to the start's side."""
    ca, cb = _g(a, 4), _g(b, 4)
    dot = ((ca[0] * cb[0] + ca[1] * cb[1]) + ca[2] * cb[2]) + ca[3] * cb[3]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    out = vec(*[(x - alpha * x) + alpha * (y * sign) for x, y in zip(ca, cb, strict=True)])
    return q_normalize(out) if normalize else out


@bound("a", "b")
def v_lerp(a: Column, b: Column, alpha) -> Column:
    return vec(*[(x - alpha * x) + alpha * y for x, y in zip(_g(a, 3), _g(b, 3), strict=True)])


def qvv(q: Column, t: Column, s: Column) -> Column:
    return F.struct(q.alias("q"), t.alias("t"), s.alias("s"))


def identity(scale: float = 1.0) -> Column:
    return qvv(vec(*IDENTITY_Q), vec(0, 0, 0), vec(scale, scale, scale))


@bound("a", "b")
def mul(a: Column, b: Column) -> Column:
    return qvv(q_mul(a["q"], b["q"]), v_add(q_rotate(v_mul(a["t"], b["s"]), b["q"]), b["t"]), v_mul(a["s"], b["s"]))


@bound("a", "b")
def mul_normalized(a: Column, b: Column) -> Column:
    return _normalized(mul(a, b))


@bound("m")
def _normalized(m: Column) -> Column:
    return qvv(q_normalize(m["q"]), m["t"], m["s"])


@bound("t", "r", "s")
def _inverse(t: Column, r: Column, s: Column) -> Column:
    return qvv(r, v_scale(q_rotate(v_mul(t, s), r), -1.0), s)


@bound("a")
def inverse(a: Column) -> Column:
    return _inverse(a["t"], q_conj(a["q"]), v_inv(a["s"]))


@bound("p", "a")
def point(p: Column, a: Column) -> Column:
    """The point in the space that ``a`` maps to."""
    return v_add(q_rotate(v_mul(p, a["s"]), a["q"]), a["t"])


@bound("a", "b")
def blend(a: Column, b: Column, alpha, normalize: bool = True) -> Column:
    return qvv(q_lerp(a["q"], b["q"], alpha, normalize), v_lerp(a["t"], b["t"], alpha), v_lerp(a["s"], b["s"], alpha))


# --- additive clips ---------------------------------------------------------------------------


@bound("base", "additive")
def apply_additive(base: Column, additive: Column, kind: str) -> Column:
    if kind == "none":
        return additive
    if kind == "relative":
        return mul(additive, base)
    q, t = q_mul(additive["q"], base["q"]), v_add(additive["t"], base["t"])
    scale = additive["s"] if kind == "additive0" else v_add(additive["s"], vec(1, 1, 1))
    return qvv(q, t, v_mul(scale, base["s"]))


@bound("base", "pose")
def to_additive(base: Column, pose: Column, kind: str) -> Column:
    if kind == "none":
        return pose
    if kind == "relative":
        return mul(pose, inverse(base))
    q, t, s = q_mul(pose["q"], q_conj(base["q"])), v_sub(pose["t"], base["t"]), v_mul(pose["s"], v_inv(base["s"]))
    return qvv(q, t, s if kind == "additive0" else v_sub(s, vec(1, 1, 1)))


# --- error metrics ----------------------------------------------------------------------------


def shell_points(distance) -> list[Column]:
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    zero = F.lit(0.0)
    return [F.array(d, zero, zero), F.array(zero, d, zero), F.array(zero, zero, d)]


@bound("raw", "lossy")
def qvv_error(raw: Column, lossy: Column, shell, with_scale: bool = True) -> Column:
    """Greatest distance of the shell's axis points between two transforms; two points do without scale."""
    return F.greatest(*[v_dist(point(p, raw), point(p, lossy)) for p in shell_points(shell)[: 3 if with_scale else 2]])


@bound("a")
def to_matrix(a: Column) -> Column:
    """Rows x, y, z axes and the translation, 12 numbers."""
    axes = [q_rotate(v_mul(vec(*e), a["s"]), a["q"]) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    return F.concat(*axes, a["t"])


@bound("a", "b")
def matrix_mul(a: Column, b: Column) -> Column:
    """Affine 3x4 product, left first."""
    out = []
    for r in range(4):
        for c in range(3):
            cell = (a.getItem(3 * r) * b.getItem(c) + a.getItem(3 * r + 1) * b.getItem(3 + c)) + a.getItem(3 * r + 2) * b.getItem(6 + c)
            out.append(cell + b.getItem(9 + c) if r == 3 else cell)
    return F.array(*out)


@bound("p", "m")
def matrix_point(p: Column, m: Column) -> Column:
    return vec(*[((p.getItem(0) * m.getItem(c) + p.getItem(1) * m.getItem(3 + c)) + p.getItem(2) * m.getItem(6 + c)) + m.getItem(9 + c) for c in range(3)])


@bound("raw", "lossy")
def matrix_error(raw: Column, lossy: Column, shell) -> Column:
    return F.greatest(*[v_dist(matrix_point(p, raw), matrix_point(p, lossy)) for p in shell_points(shell)])


# --- flat forms -------------------------------------------------------------------------------
# SQL over one plain column a component: what whole-stage code generation can compile, where the
# forms above are evaluated through array functions.


def flat_point(axis: int, shell: str, q: list[str], t: list[str], s: list[str]) -> list[str]:
    """The three coordinates of the shell's point on ``axis`` in the space of (q, t, s), given as SQL."""
    v = [f"({shell} * {s[axis]})" if i == axis else "0.0D" for i in range(3)]
    x, y, z, w = q
    turn = [f"(2.0D * ({b} * {v[k]} - {c} * {v[j]}))" for b, c, j, k in ((y, z, 1, 2), (z, x, 2, 0), (x, y, 0, 1))]
    return [f"({v[i]} + {w} * {turn[i]} + ({b} * {turn[k]} - {c} * {turn[j]}) + {t[i]})" for i, (b, c, j, k) in enumerate(((y, z, 1, 2), (z, x, 2, 0), (x, y, 0, 1)))]


def flat_qvv_error(raw: list[list[str]], lossy: list[list[str]]) -> str:
    """The greatest distance between the shell points of two transforms, as SQL over their coordinates."""
    apart = ["sqrt(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(p, r, strict=True)) + ")" for p, r in zip(raw, lossy, strict=True)]
    return f"greatest({', '.join(apart)})"
