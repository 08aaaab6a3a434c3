"""Transforms as numpy arrays (frames x bones), for grouped searches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

SEGMENTS = 64  # a block
PARTS = [*(f"q{i}" for i in range(4)), *(f"t{i}" for i in range(3)), *(f"s{i}" for i in range(3))]


class Pose(NamedTuple):
    q: np.ndarray
    t: np.ndarray
    s: np.ndarray


def stack(pdf: pd.DataFrame, frames: int, bones: int) -> Pose:
    """From rows sorted by frame and bone."""
    return Pose(*[np.stack(pdf[c].to_numpy()).reshape(frames, bones, -1).astype(float) for c in "qts"])


def in_blocks(poses: DataFrame, *more: str) -> GroupedData:
    """Poses (…, segment_index, …) grouped into runs of segments of a clip, with a column a component.

    The number of partitions is fixed: these rows are few bytes for the work they make.
    """
    parts = [F.col(c[0]).getItem(int(c[1])).alias(c) for c in PARTS]
    block = F.floor(F.col("segment_index") / SEGMENTS).alias("_block")
    rows = poses.select("clip_id", block, "segment_index", "sample_index", "bone", "parent", *parts, *more)
    spread = max(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), poses.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(spread, "clip_id", "_block").groupBy("clip_id", "_block")


class Block:
    """The segments of one group of :func:`in_blocks`: frames one after the other, each with all bones."""

    def __init__(self, pdf: pd.DataFrame):
        self.pdf = pdf.sort_values(["segment_index", "sample_index", "bone"])
        self.bones = self.pdf["bone"].nunique()
        frames = self.pdf.iloc[:: self.bones]
        self.clip_id = frames["clip_id"].iloc[0]
        self.parents = [None if pd.isna(p) else int(p) for p in self.pdf["parent"].to_numpy()[: self.bones]]
        self.samples = frames["sample_index"].to_numpy()
        self.segments, self.starts, self.sizes = np.unique(frames["segment_index"].to_numpy(), return_index=True, return_counts=True)
        values = self.pdf[PARTS].to_numpy(float).reshape(len(frames), self.bones, 10)
        self.pose = Pose(values[..., :4], values[..., 4:7], values[..., 7:])


def take(x: Pose, frames) -> Pose:
    return Pose(*[a[frames] for a in x])


def q_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First a, then b."""
    av, aw, bv, bw = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([bw * av + aw * bv + np.cross(bv, av), aw * bw - (av * bv).sum(-1, keepdims=True)], -1)


def rotate(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    u = 2.0 * np.cross(q[..., :3], v)
    return v + q[..., 3:] * u + np.cross(q[..., :3], u)


def unit(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=-1, keepdims=True)
    return np.where(n < 1e-12, np.array([0.0, 0.0, 0.0, 1.0]), q / np.where(n < 1e-12, 1.0, n))


def to_object(local: Pose, parents) -> Pose:
    q, t, s = (a.copy() for a in local)
    for b, p in enumerate(parents):
        if p is None or (isinstance(p, float) and np.isnan(p)) or pd.isna(p):
            continue
        p = int(p)
        t[:, b] = rotate(t[:, b] * s[:, p], q[:, p]) + t[:, p]
        q[:, b] = unit(q_mul(q[:, b], q[:, p]))
        s[:, b] = s[:, b] * s[:, p]
    return Pose(q, t, s)


def blend(a: Pose, b: Pose, alpha: np.ndarray) -> Pose:
    """``alpha`` has a row a frame; ends are flipped to the start's side."""
    k = alpha[..., None]
    sign = np.where((a.q * b.q).sum(-1, keepdims=True) < 0, -1.0, 1.0)
    return Pose(unit((1 - k) * a.q + k * (b.q * sign)), (1 - k) * a.t + k * b.t, (1 - k) * a.s + k * b.s)


def error(raw: Pose, lossy: Pose, shell) -> np.ndarray:
    """(frames, bones): the greatest distance of the three axis points at ``shell``."""
    out = np.zeros(raw.q.shape[:-1])
    for axis in range(3):
        p = np.zeros((*out.shape, 3))
        p[..., axis] = shell
        at = [rotate(p * x.s, x.q) + x.t for x in (raw, lossy)]
        out = np.maximum(out, np.linalg.norm(at[0] - at[1], axis=-1))
    return out
