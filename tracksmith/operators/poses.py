"""Transform clips: hierarchy, interpolation, pre-processing, shells, error and default handling.

Pose tables are (clip_id, sample_index, bone, parent, q, t, s). A whole pose is walked as one
parent-first array per row, so a hierarchy of any depth is one shuffle and no recursion.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.functions import qvv

POSE = ["clip_id", "sample_index", "bone"]


class ErrorMetric(Protocol):
    """How far two transforms of one bone are apart, as a Column; users may bring their own."""

    def error(self, raw: Column, lossy: Column, shell: Column) -> Column: ...


class QvvMetric:
    name = "qvvf"

    def error(self, raw: Column, lossy: Column, shell: Column) -> Column:
        return qvv.qvv_error(raw, lossy, shell)


class MatrixMetric:
    name = "matrix3x4f"

    def error(self, raw: Column, lossy: Column, shell: Column) -> Column:
        return qvv.matrix_error(qvv.to_matrix(raw), qvv.to_matrix(lossy), shell)


class AdditiveMetric:
    """Applies an additive pair to its base before measuring; the base is a struct column."""

    def __init__(self, kind: str, base: Column):
        self.kind, self.base, self.name = kind, base, f"additive_{kind}"

    def error(self, raw: Column, lossy: Column, shell: Column) -> Column:
        apply = lambda x: qvv.apply_additive(self.base, x, self.kind)
        return qvv.qvv_error(apply(raw), apply(lossy), shell)


def transform() -> Column:
    return qvv.qvv(F.col("q"), F.col("t"), F.col("s"))


def pose_arrays(poses: DataFrame) -> DataFrame:
    """(clip_id, sample_index, pose): bones in index order, parents before children."""
    bone = F.struct("bone", "parent", transform().alias("x"))
    return poses.groupBy("clip_id", "sample_index").agg(F.array_sort(F.collect_list(bone)).alias("pose"))


def _unfold(df: DataFrame, column: str) -> DataFrame:
    rows = df.select("clip_id", "sample_index", F.explode(column).alias("b"))
    return rows.select("clip_id", "sample_index", "b.bone", "b.parent", "b.x.q", "b.x.t", "b.x.s")


def to_object_space(poses: DataFrame) -> DataFrame:
    """obj[i] = normalize(local[i] * obj[parent]); roots stay. Bones are numbered 0..n-1, parents first."""

    def step(done: Column, b: Column) -> Column:
        parent = done[b["parent"]]["x"]
        moved = F.when(b["parent"].isNull(), b["x"]).otherwise(qvv.mul_normalized(b["x"], parent))
        return F.concat(done, F.array(F.struct(b["bone"].alias("bone"), b["parent"].alias("parent"), moved.alias("x"))))

    arrays = pose_arrays(poses)
    start = F.slice("pose", 1, 0)
    return _unfold(arrays.withColumn("pose", F.aggregate("pose", start, step)), "pose")


def to_local_space(poses: DataFrame, parent_first: bool = False) -> DataFrame:
    """The local transforms of object-space ones, by a self-join on the parent.

    ``parent_first`` multiplies the inverse parent from the left, as some engines do; the
    default undoes :func:`to_object_space`.
    """
    parents = poses.select("clip_id", "sample_index", F.col("bone").alias("parent"), transform().alias("px"))
    met = poses.join(parents, ["clip_id", "sample_index", "parent"], "left")
    inv = qvv.inverse(F.col("px"))
    local = qvv.mul_normalized(inv, transform()) if parent_first else qvv.mul_normalized(transform(), inv)
    out = F.when(F.col("px").isNull(), transform()).otherwise(local)
    return met.select(*POSE, "parent", out.alias("x")).select(*POSE, "parent", "x.q", "x.t", "x.s")


def bone_chains(bones: DataFrame) -> DataFrame:
    """(clip_id, bone, depth, chain): the bones from the root down, for bones (clip_id, bone, parent)."""
    spark = bones.sparkSession
    bones.createOrReplaceTempView("_bones")
    return spark.sql(
        """WITH RECURSIVE walk (clip_id, bone, depth, chain) AS (
             SELECT clip_id, bone, 0, array(bone) FROM _bones WHERE parent IS NULL
             UNION ALL
             SELECT b.clip_id, b.bone, w.depth + 1, concat(w.chain, array(b.bone)) FROM walk w JOIN _bones b ON b.clip_id = w.clip_id AND b.parent = w.bone
           ) SELECT * FROM walk"""
    )


def parent_first_order(bones: DataFrame) -> DataFrame:
    """Adds order: by depth, then index, which holds for any numbering."""
    from pyspark.sql import Window

    return bone_chains(bones).withColumn("order", F.row_number().over(Window.partitionBy("clip_id").orderBy("depth", "bone")) - 1)


def automatic_level(bones: DataFrame) -> DataFrame:
    """(clip_id, level) by the number of bones and the longest chain."""
    found = bone_chains(bones).groupBy("clip_id").agg(F.count("*").alias("n"), (F.max("depth") + 1).alias("longest"))
    level = F.when(F.col("n") > 500, "medium").when(F.col("longest") < 18, "highest").when(F.col("longest") < 25, "high").otherwise("medium")
    return found.select("clip_id", "longest", level.alias("level"))


def dominant_shells(poses: DataFrame, shells: DataFrame, levels: int) -> DataFrame:
    """(clip_id, bone, shell, precision): leaves first, a child that reaches further than its parent's
    shell hands its reach and its precision up.

    ``shells`` (clip_id, bone, parent, depth, shell, precision); ``levels`` is the greatest depth.
    Each level is one aggregate over the samples of its bones.
    """
    now = shells.select("clip_id", "bone", "parent", "depth", "shell", "precision")
    for depth in range(levels, 0, -1):
        children = now.where(F.col("depth") == depth).select("clip_id", "bone", "parent", "shell", "precision")
        met = poses.drop("parent").join(children, ["clip_id", "bone"])
        reach = F.greatest(*[qvv.v_len(qvv.point(p, transform())) for p in qvv.shell_points(F.col("shell"))])
        reached = met.groupBy("clip_id", "parent", "bone", "precision").agg((F.max(reach) + F.first("precision")).alias("reach"))
        best = reached.groupBy("clip_id", "parent").agg(F.max_by(F.struct("reach", "precision"), F.struct("reach", -F.col("bone"))).alias("b"))
        best = best.select("clip_id", F.col("parent").alias("bone"), F.col("b.reach").alias("reach"), F.col("b.precision").alias("reach_precision"))
        met = now.join(best, ["clip_id", "bone"], "left")
        more = F.coalesce(F.col("reach") > F.col("shell"), F.lit(False))
        now = met.select("clip_id", "bone", "parent", "depth", F.when(more, F.col("reach")).otherwise(F.col("shell")).alias("shell"), F.when(more, F.col("reach_precision")).otherwise(F.col("precision")).alias("precision"))
    return now


def sub_track_classes(poses: DataFrame, shells: DataFrame, metric: ErrorMetric | None = None) -> DataFrame:
    """(clip_id, bone, sub_track, class): default, constant or animated.

    A sub-track is constant if its first sample can stand for every sample within the bone's
    precision, default if, being constant, the default value can.
    """
    first = poses.where("sample_index = 0").select("clip_id", "bone", F.col("q").alias("q0"), F.col("t").alias("t0"), F.col("s").alias("s0"))
    met = poses.join(first, ["clip_id", "bone"]).join(shells.select("clip_id", "bone", "shell", "precision"), ["clip_id", "bone"])
    swaps = {"rotation": (("q0", "t", "s"), ("qd", "t", "s")), "translation": (("q", "t0", "s"), ("q", "td", "s")), "scale": (("q", "t", "s0"), ("q", "t", "sd"))}
    plain = {"qd": qvv.vec(*qvv.IDENTITY_Q), "td": qvv.vec(0, 0, 0), "sd": qvv.vec(1, 1, 1)}
    if metric is None or type(metric) is QvvMetric:
        found = _flat_swap_errors(met, swaps, plain)
    else:
        of = lambda names: qvv.qvv(*[plain.get(n, F.col(n)) for n in names])
        found = met.groupBy("clip_id", "bone", "precision").agg(
            *[F.max(metric.error(transform(), of(x), F.col("shell"))).alias(f"{name}_{kind}") for name, both in swaps.items() for kind, x in zip(("c", "d"), both, strict=True)]
        )
    col = F.col
    kinds = F.array(
        *[
            F.struct(F.lit(name).alias("sub_track"), F.when(col(f"{name}_c") > col("precision"), "animated").when(col(f"{name}_d") > col("precision"), "constant").otherwise("default").alias("class"))
            for name in swaps
        ]
    )
    return found.select("clip_id", "bone", F.explode(kinds).alias("k")).select("clip_id", "bone", "k.sub_track", "k.class")


def _flat_swap_errors(met: DataFrame, swaps: dict, plain: dict) -> DataFrame:
    """The worst error of every swap by the plain metric, over one column a component."""
    wide = met.withColumns(plain)
    width = {"q": 4, "t": 3, "s": 3}
    parts = {c: [f"{c}_{i}" for i in range(width[c[0]])] for c in ("q", "t", "s", "q0", "t0", "s0", *plain)}
    wide = wide.select("clip_id", "bone", "precision", "shell", *[F.col(c).getItem(i).alias(n) for c, names in parts.items() for i, n in enumerate(names)])
    points = lambda q, t, s: [qvv.flat_point(a, "shell", parts[q], parts[t], parts[s]) for a in range(3)]
    raw = points("q", "t", "s")
    names = [[f"p{a}{i}" for i in range(3)] for a in range(3)]
    wide = wide.select("*", *[F.expr(raw[a][i]).alias(names[a][i]) for a in range(3) for i in range(3)])
    of = [F.expr(qvv.flat_qvv_error(names, points(*x))).alias(f"{name}_{kind}") for name, both in swaps.items() for kind, x in zip(("c", "d"), both, strict=True)]
    errors = wide.select("clip_id", "bone", "precision", *of)
    return errors.groupBy("clip_id", "bone", "precision").agg(*[F.max(f"{name}_{kind}").alias(f"{name}_{kind}") for name in swaps for kind in ("c", "d")])


def pose_errors(raw: DataFrame, lossy: DataFrame, shell: float = 3.0, metric: ErrorMetric | None = None) -> DataFrame:
    """(clip_id, sample_index, bone, error) of two tables in the same space."""
    metric = metric or QvvMetric()
    other = lossy.select(*POSE, transform().alias("lx"))
    met = raw.select(*POSE, transform().alias("rx")).join(other, POSE)
    return met.select(*POSE, metric.error(F.col("rx"), F.col("lx"), F.lit(float(shell))).alias("error"))


def worst_pose_error(found: DataFrame, rate: float) -> DataFrame:
    """(clip_id, bone, error, time): of equal errors the earliest sample, then the first bone."""
    worst = F.max_by(F.struct("bone", "sample_index", "error"), F.struct("error", -F.col("sample_index"), -F.col("bone")))
    return found.groupBy("clip_id").agg(worst.alias("w")).select("clip_id", "w.bone", "w.error", (F.col("w.sample_index") / rate).alias("time"))


def sample_poses(poses: DataFrame, sought: DataFrame, normalize: bool = True) -> DataFrame:
    """Interpolated poses at sought requests: (clip_id, request_id, bone, q, t, s)."""
    first = poses.select("clip_id", F.col("sample_index").alias("key0"), "bone", transform().alias("x0"))
    second = poses.select("clip_id", F.col("sample_index").alias("key1"), "bone", transform().alias("x1"))
    met = sought.join(first, ["clip_id", "key0"]).join(second, ["clip_id", "key1", "bone"])
    out = qvv.blend(F.col("x0"), F.col("x1"), F.col("alpha"), normalize)
    return met.select("clip_id", "request_id", "bone", out.alias("x")).select("clip_id", "request_id", "bone", "x.q", "x.t", "x.s")


def fill_defaults(poses: DataFrame, classes: DataFrame, mode: str, sub_track: str = "scale", additive1: bool = False, defaults: DataFrame | None = None) -> DataFrame:
    """The values of default sub-tracks by mode: left out, a constant, each bone's own, or the legacy scale.

    ``defaults`` (clip_id, bone, value) has each bone's own; one that it lacks is the constant.
    """
    column = {"rotation": "q", "translation": "t", "scale": "s"}[sub_track]
    constant = {"rotation": qvv.vec(*qvv.IDENTITY_Q), "translation": qvv.vec(0, 0, 0), "scale": qvv.vec(1, 1, 1)}[sub_track]
    of = classes.where(F.col("sub_track") == sub_track).select("clip_id", "bone", (F.col("class") == "default").alias("is_default"))
    met = poses.join(of, ["clip_id", "bone"])
    if mode == "variable":
        if defaults is None:
            raise ValueError("variable defaults need a table of them")
        met = met.join(defaults.select("clip_id", "bone", F.col("value").alias("_own")), ["clip_id", "bone"], "left")
    value = {
        "skipped": F.lit(None).cast("array<double>"),
        "constant": constant,
        "variable": F.coalesce("_own", constant) if mode == "variable" else None,
        "legacy": qvv.vec(*[0.0 if additive1 else 1.0] * 3) if sub_track == "scale" else constant,
    }[mode]
    return met.withColumn(column, F.when(F.col("is_default"), value).otherwise(F.col(column))).drop("is_default", "_own")


def pose_loops(poses: DataFrame, shells: DataFrame, metric: ErrorMetric | None = None) -> DataFrame:
    """(clip_id, num_samples, loops): first and last pose agree within every bone's precision at its shell."""
    metric = metric or QvvMetric()
    x = transform()
    ends = poses.groupBy("clip_id", "bone").agg(F.min_by(x, "sample_index").alias("x0"), F.max_by(x, "sample_index").alias("x1"), F.count("*").alias("n"))
    met = ends.join(shells.select("clip_id", "bone", "shell", "precision"), ["clip_id", "bone"])
    same = metric.error(F.col("x0"), F.col("x1"), F.col("shell")) <= F.col("precision")
    return met.groupBy("clip_id").agg(F.max("n").alias("num_samples"), ((F.max("n") > 1) & F.bool_and(same)).alias("loops"))


def trim_pose_loops(poses: DataFrame, loops: DataFrame) -> DataFrame:
    return poses.join(loops, "clip_id").where("NOT loops OR sample_index < num_samples - 1").select(*poses.columns)


def sanitize(poses: DataFrame, classes: DataFrame) -> DataFrame:
    """Constant sub-tracks become their first sample, default ones the default value."""
    first = poses.where("sample_index = 0").select("clip_id", "bone", F.col("q").alias("q0"), F.col("t").alias("t0"), F.col("s").alias("s0"))
    wide = classes.groupBy("clip_id", "bone").pivot("sub_track", ["rotation", "translation", "scale"]).agg(F.first("class"))
    met = poses.join(first, ["clip_id", "bone"]).join(wide, ["clip_id", "bone"])
    plain = {"q": ("rotation", qvv.vec(*qvv.IDENTITY_Q)), "t": ("translation", qvv.vec(0, 0, 0)), "s": ("scale", qvv.vec(1, 1, 1))}
    new = {c: F.when(F.col(k) == "default", d).when(F.col(k) == "constant", F.col(f"{c}0")).otherwise(F.col(c)) for c, (k, d) in plain.items()}
    return met.withColumns(new).select(*poses.columns)


def clip_flags(classes: DataFrame) -> DataFrame:
    """(clip_id, has_scale, num_default, num_constant, num_animated, constant_bytes): three floats a constant."""
    kind = lambda c: F.count_if(F.col("class") == c)
    return classes.groupBy("clip_id").agg(
        F.bool_or((F.col("sub_track") == "scale") & (F.col("class") != "default")).alias("has_scale"),
        kind("default").alias("num_default"),
        kind("constant").alias("num_constant"),
        kind("animated").alias("num_animated"),
        (kind("constant") * 12).alias("constant_bytes"),
    )


def base_time(time, duration, base_duration) -> Column:
    """When an additive clip's base is sampled: the same share of its own duration."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(c(duration) <= 0, 0.0).otherwise(c(time) / F.when(c(duration) <= 0, 1.0).otherwise(c(duration)) * c(base_duration))
