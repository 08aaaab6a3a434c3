"""Compression of transform clips: choosing bit rates per bone, sub-track and segment.

Rates seen by a bone depend on those of its ancestors, so the search is sequential within a
segment and independent between segments: the segments of a block take each step at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.model import BIT_RATES, HIGHEST_RATE, RAW_RATE
from tracksmith.operators import rigid

SUBS = ("rotation", "translation", "scale")
DEFAULTS = ((0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
ROWS = 10_000  # poses of a bone in one search; each is kept at all 25 rates
RATES = "clip_id long, segment_index int, bone int, rotation int, translation int, scale int, error double"
LOSSY = "clip_id long, segment_index int, sample_index int, bone int, parent int, q array<double>, t array<double>, s array<double>"


class BlockSearch:
    """Segments of one clip, searched side by side: what every bit rate makes of their frames, and the rates.

    Frames are (segments, width, frames); a segment of fewer frames repeats its last. ``kinds`` (bones x 3).
    """

    def __init__(self, pose: rigid.Pose, sizes: np.ndarray, parents: list[int | None], kinds: np.ndarray, precision: float, shell: float):
        self.sizes, self.parents, self.precision, self.shell = sizes, parents, precision, shell
        self.bones = len(parents)
        starts = np.cumsum(sizes) - sizes
        at = starts[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)
        self.real = np.arange(sizes.max()) < sizes[:, None]
        flip = np.where(pose.q[..., 3:] < 0, -1.0, 1.0)
        raw = rigid.Pose(pose.q * flip, pose.t, pose.s)
        moved = rigid.to_object(raw, parents)
        parts = lambda x: [[a[:, b][at].transpose(0, 2, 1) for a in x] for b in range(self.bones)]
        self.raw, self.object = parts(raw), parts(moved)
        self.animated = kinds == "animated"
        self.rates = np.where(self.animated, 1, 0) * np.ones((len(sizes), 1, 1), int)
        self.tables = [[self.decoded(b, sub, kinds[b, sub]) for sub in range(3)] for b in range(self.bones)]

    def decoded(self, bone: int, sub: int, kind: str) -> np.ndarray:
        """(rates, segments, width, frames); a sub-track that is not animated is the same at all rates."""
        values = self.raw[bone][sub]
        if kind != "animated":
            still = values[..., :1] if kind == "constant" else np.array(DEFAULTS[sub])[None, :, None]
            return np.broadcast_to(still, (RAW_RATE + 1, *values.shape))
        part = values[:, :3]
        low, extent = part.min(-1, keepdims=True), np.ptp(part, axis=-1, keepdims=True)
        top = np.array([2.0 ** max(1, bits) - 1 for bits in BIT_RATES[:RAW_RATE]])[:, None, None, None]
        norm = np.where(extent < 1e-9, 0.0, (part - low) / np.where(extent < 1e-9, 1.0, extent))
        out = np.concatenate([np.floor(norm * top + 0.5) / top * extent + low, part.astype(np.float32).astype(float)[None]])
        if sub == 0:
            x, y, z = (out[:, :, i] for i in range(3))
            w = np.sqrt(np.abs(1.0 - (x * x + y * y + z * z)))
            out = np.stack(_unit([x, y, z, w]), 2)
        return out

    def at(self, segments: np.ndarray, bone: int, more: bool = False) -> list[list[np.ndarray]]:
        """Components of a bone's transforms; with ``more`` stacked in three, each with another sub-track a rate higher."""
        out = []
        for sub in range(3):
            rate = self.rates[segments, bone, sub]
            now = self.tables[bone][sub][rate, segments]
            if more:
                now = np.stack([self.tables[bone][sub][np.minimum(rate + 1, RAW_RATE), segments] if i == sub else now for i in range(3)])
            out.append(list(np.moveaxis(now, -2, 0)))
        return out

    def error(self, segments: np.ndarray, raw: list[np.ndarray], lossy: list[list[np.ndarray]]) -> np.ndarray:
        true = [list(np.moveaxis(a[segments], -2, 0)) for a in raw]
        return np.maximum.reduce([_distance(_point(axis, self.shell, *true), _point(axis, self.shell, *lossy)) for axis in range(3)]).max(-1)

    def chain(self, bone: int) -> list[int]:
        out = [bone]
        while self.parents[out[-1]] is not None:
            out.append(self.parents[out[-1]])
        return out[::-1]

    def along(self, segments: np.ndarray, chain: list[int], parent: list | None = None) -> list:
        """The last bone of a chain in the space of the first one's parent."""
        for bone in chain:
            local = self.at(segments, bone)
            parent = local if parent is None else _child(local, parent)
        return parent

    def object_error(self, segments: np.ndarray, bone: int) -> np.ndarray:
        return self.error(segments, self.object[bone], self.along(segments, self.chain(bone)))

    def tried(self, segments: np.ndarray, raw: list[np.ndarray], chain: list[int]) -> np.ndarray:
        """(bones of the chain x 3, segments): the error of the last bone with one rate raised; infinite where none can be."""
        out, parent = [], None
        for i, bone in enumerate(chain):
            more = self.at(segments, bone, more=True)
            moved = more if parent is None else _child(more, parent)
            out.append(self.error(segments, raw, self.along(segments, chain[i + 1 :], moved)))
            if i + 1 < len(chain):
                parent = self.along(segments, [bone], parent)
        can = self.animated[chain].reshape(-1, 1) & (self.rates[segments][:, chain].reshape(len(segments), -1).T < RAW_RATE)
        return np.where(can, np.concatenate(out), np.inf)

    def raise_rates(self, raw: list[np.ndarray], chain: list[int], error: np.ndarray) -> None:
        """Until the last bone's error is below the precision, raises the rate in the chain that leaves the least; of equal ones the first."""
        left = np.nonzero(error >= self.precision)[0]
        while len(left):
            found = self.tried(left, raw, chain)
            best = found.argmin(0)
            least = found[best, np.arange(len(left))]
            can = least < np.inf
            left, best, least = left[can], best[can], least[can]
            self.rates[left, np.array(chain)[best // 3], best % 3] += 1
            left = left[least >= self.precision]

    def search(self) -> None:
        every = np.arange(len(self.sizes))
        for bone in range(self.bones):
            self.raise_rates(self.raw[bone], [bone], self.error(every, self.raw[bone], self.at(every, bone)))
        for bone in range(self.bones):
            self.raise_rates(self.object[bone], self.chain(bone), self.object_error(every, bone))

    def lossy(self) -> rigid.Pose:
        """Frames one after the other, as they came."""
        every = np.arange(len(self.sizes))
        return rigid.Pose(*[np.stack([np.stack(self.at(every, b)[sub], -1)[self.real] for b in range(self.bones)], 1) for sub in range(3)])


def _unit(q: list) -> list:
    x, y, z, w = q
    n = np.sqrt(x * x + y * y + z * z + w * w)
    tiny, d = n < 1e-12, np.where(n < 1e-12, 1.0, n)
    return [np.where(tiny, e, c / d) for c, e in zip(q, DEFAULTS[0], strict=True)]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _rotate(v: list, q: list) -> list:
    u = [2.0 * c for c in _cross(q, v)]
    return [a + q[3] * b + c for a, b, c in zip(v, u, _cross(q, u), strict=True)]


def _child(a: list, b: list) -> list:
    """The transform a in the space of its parent b."""
    t = [x + y for x, y in zip(_rotate([x * y for x, y in zip(a[1], b[2], strict=True)], b[0]), b[1], strict=True)]
    (ax, ay, az, aw), (bx, by, bz, bw) = a[0], b[0]
    q = [bw * x + aw * y + c for x, y, c in zip(a[0][:3], b[0][:3], _cross(b[0], a[0]), strict=True)]
    return [_unit([*q, aw * bw - (ax * bx + ay * by + az * bz)]), t, [x * y for x, y in zip(a[2], b[2], strict=True)]]


def _point(axis: int, shell: float, q: list, t: list, s: list) -> list:
    """Where the axis point at the shell goes: :func:`_rotate` without the products by nought."""
    i, j, k = axis, (axis + 1) % 3, (axis + 2) % 3
    v = shell * s[i]
    uj, uk = 2.0 * (q[k] * v), 2.0 * -(q[j] * v)
    out = [None] * 3
    out[i] = v + (q[j] * uk - q[k] * uj) + t[i]
    out[j] = q[3] * uj - q[i] * uk + t[j]
    out[k] = q[3] * uk + q[i] * uj + t[k]
    return out


def _distance(a: list, b: list) -> np.ndarray:
    x, y, z = (c - d for c, d in zip(a, b, strict=True))
    return np.sqrt(x * x + y * y + z * z)


def _with_classes(poses: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the classes of a bone's sub-tracks to its rows; one that is missing is animated."""
    one = classes.groupBy("clip_id", "bone").agg(*[F.max(F.when(F.col("sub_track") == s, F.col("class"))).alias(s) for s in SUBS])
    return poses.join(one, ["clip_id", "bone"], "left").fillna("animated", list(SUBS))


def _searched(pdf: pd.DataFrame, precision: float, shell: float) -> Iterator[tuple[rigid.Block, slice, BlockSearch]]:
    """A block in runs of segments that keep the tables of all rates small."""
    block = rigid.Block(pdf)
    kinds = block.pdf[list(SUBS)].to_numpy()[: block.bones]
    run = max(1, ROWS // (block.bones * int(block.sizes.max())))
    for i in range(0, len(block.sizes), run):
        sizes = block.sizes[i : i + run]
        frames = slice(block.starts[i], block.starts[i] + sizes.sum())
        found = BlockSearch(rigid.take(block.pose, frames), sizes, block.parents, kinds, precision, shell)
        found.search()
        yield block, slice(i, i + run), found


def bit_rates(poses: DataFrame, classes: DataFrame, precision: float = 0.01, shell: float = 3.0) -> DataFrame:
    """Rates of every bone in every segment of poses (…, segment_index, …) and the object-space error left."""

    def rates(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, run, found in _searched(pdf, precision, shell):
            n, every = len(found.sizes), np.arange(len(found.sizes))
            error = np.stack([found.object_error(every, b) for b in range(found.bones)], 1)
            keys = {"clip_id": block.clip_id, "segment_index": np.repeat(block.segments[run], found.bones), "bone": np.tile(np.arange(found.bones), n)}
            out.append(pd.DataFrame({**keys, **{s: found.rates[..., i].ravel() for i, s in enumerate(SUBS)}, "error": error.ravel()}))
        return pd.concat(out)

    return rigid.in_blocks(_with_classes(poses, classes), *SUBS).applyInPandas(rates, RATES)


def compress_poses(poses: DataFrame, classes: DataFrame, precision: float = 0.01, shell: float = 3.0) -> DataFrame:
    """The poses as they decode from the chosen rates."""

    def lossy(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [(block, found.lossy()) for block, _, found in _searched(pdf, precision, shell)]
        out = runs[0][0].pdf[["clip_id", "segment_index", "sample_index", "bone", "parent"]].copy()
        for i, name in enumerate("qts"):
            values = np.concatenate([x[i] for _, x in runs])
            out[name] = list(values.reshape(len(out), -1))
        return out

    return rigid.in_blocks(_with_classes(poses, classes), *SUBS).applyInPandas(lossy, LOSSY)


def animated_sizes(rates: DataFrame) -> DataFrame:
    """(clip_id, segment_index, bits_per_pose): three components each."""
    bits = lambda c: F.when(F.col(c) == RAW_RATE, 32).otherwise(F.col(c)) * 3
    return rates.groupBy("clip_id", "segment_index").agg(F.sum(bits("rotation") + bits("translation") + bits("scale")).alias("bits_per_pose"))


assert HIGHEST_RATE + 1 == RAW_RATE
