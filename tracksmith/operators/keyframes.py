"""How much keyframes matter: contributing error, clip-wide stripping order, stripping.

Removing a keyframe changes its neighbours, so ranking inside a segment is sequential; the
segments of a block take each step at once in numpy. Merging the segments' orders is set-based:
repeatedly taking the least head of several lists sorts by the running maximum in each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators import rigid

INFINITE = float("inf")
RANKED = "clip_id long, segment_index int, sample_index int, position int, error double, movable boolean"


def removal_orders(sizes: np.ndarray, errors_of: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(frames, errors), a row a list of ``sizes`` frames, in the order of removal; the first and last
    frame come last, at infinity. All lists take a step at once.

    ``errors_of(lists, a, k, b)`` are the worst errors of the frames between the retained a and b if
    k, between them, goes too. Places past a list's size hold -1.
    """
    lists, most = np.arange(len(sizes)), int(sizes.max(initial=0))
    places = np.arange(most)
    before, after = np.tile(places - 1, (len(lists), 1)), np.tile(places + 1, (len(lists), 1))
    kept = (places >= 1) & (places < sizes[:, None] - 1)
    cost = np.full(kept.shape, INFINITE)
    s, k = np.nonzero(kept)
    if len(s):
        cost[s, k] = errors_of(s, k - 1, k, k + 1)
    frames, errors = np.full(kept.shape, -1), np.full(kept.shape, INFINITE)
    for place in range(most - 2):
        s = lists[kept.any(1)]
        k = np.where(kept[s], cost[s], INFINITE).argmin(1)
        frames[s, place], errors[s, place] = k, cost[s, k]
        kept[s, k] = False
        a, b = before[s, k], after[s, k]
        after[s, a], before[s, b] = b, a
        s, k = np.concatenate([s, s]), np.concatenate([a, b])
        s, k = s[kept[s, k]], k[kept[s, k]]
        if len(s):
            cost[s, k] = errors_of(s, before[s, k], k, after[s, k])
    for i, n in enumerate(sizes):
        ends = sorted({0, n - 1}) if n else []
        frames[i, n - len(ends) : n] = ends
    return frames, errors


def removal_order(n: int, error_of: Callable[[int, int, int], float]) -> list[tuple[int, float]]:
    """:func:`removal_orders` of one list, as (frame, error)."""
    frames, errors = removal_orders(np.array([n]), lambda _, *ends: np.array([error_of(*map(int, e)) for e in zip(*ends, strict=True)]))
    return [(int(k), float(e)) for k, e in zip(frames[0], errors[0], strict=True)]


def contributing_error(poses: DataFrame, shell: float = 3.0) -> DataFrame:
    """Ranks the frames of each segment of poses (…, segment_index, sample_index, bone, parent, q, t, s)."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        block = rigid.Block(pdf)
        local, whole = block.pose, rigid.to_object(block.pose, block.parents)

        def errors_of(s: np.ndarray, a: np.ndarray, k: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The frames between of all tasks are one array."""
            n, first = b - a - 1, block.starts[s]
            ends = np.cumsum(n)
            task = np.repeat(np.arange(len(n)), n)
            inner = a[task] + 1 + np.arange(ends[-1]) - (ends - n)[task]
            alpha = (inner - a[task]) / (b - a)[task]
            between = rigid.blend(rigid.take(local, (first + a)[task]), rigid.take(local, (first + b)[task]), alpha[:, None])
            error = rigid.error(rigid.take(whole, first[task] + inner), rigid.to_object(between, block.parents), shell)
            return np.maximum.reduceat(error.max(1), ends - n)

        frames, errors = removal_orders(block.sizes, errors_of)
        s, place = np.nonzero(frames >= 0)
        k, error = frames[s, place], errors[s, place]
        return pd.DataFrame(
            {
                "clip_id": block.clip_id,
                "segment_index": block.segments[s],
                "sample_index": block.samples[block.starts[s] + k],
                "position": place,
                "error": error,
                "movable": error != INFINITE,
            }
        )

    return rigid.in_blocks(poses).applyInPandas(rank, RANKED)


def proxy_error(frames: DataFrame) -> DataFrame:
    """A closed-form rank: the size of a frame's second difference; ends are infinite.

    ``frames`` (clip_id, segment_index, sample_index, frame array).
    """
    w = Window.partitionBy("clip_id", "segment_index").orderBy("sample_index")
    before, after = F.lag("frame").over(w), F.lead("frame").over(w)
    bend = F.aggregate(F.zip_with(F.zip_with(before, after, lambda a, b: a + b), F.col("frame"), lambda s, x: (s - 2.0 * x) * (s - 2.0 * x)), F.lit(0.0), lambda a, x: a + x)
    error = F.when(before.isNull() | after.isNull(), INFINITE).otherwise(F.sqrt(bend))
    ranked = frames.withColumn("error", error)
    order = Window.partitionBy("clip_id", "segment_index").orderBy("error", "sample_index")
    return ranked.select("clip_id", "segment_index", "sample_index", (F.row_number().over(order) - 1).alias("position"), "error", (F.col("error") < INFINITE).alias("movable"))


def stripping_order(ranked: DataFrame) -> DataFrame:
    """Adds stripping_index: the clip-wide order of removal; of equal errors the later segment goes first."""
    run = F.max("error").over(Window.partitionBy("clip_id", "segment_index").orderBy("position"))
    order = Window.partitionBy("clip_id").orderBy("_run", F.desc("segment_index"), "position")
    return ranked.withColumn("_run", run).withColumn("stripping_index", F.row_number().over(order) - 1).drop("_run")


def strip_keyframes(ordered: DataFrame, proportion: float, threshold: float, precision: float = 0.0) -> DataFrame:
    """Adds stripped. Trivial frames (error at most ``precision``) at the front go, then those up to
    the threshold, at least the proportion of all frames, at most the movable ones."""
    trivial = F.col("movable") & (F.col("error") <= precision)
    found = ordered.groupBy("clip_id").agg(
        F.count("*").alias("n"),
        F.count_if("movable").alias("most"),
        F.coalesce(F.min(F.when(~trivial, F.col("stripping_index"))), F.count("*")).alias("p1"),
    )
    met = ordered.join(found, "clip_id")
    past = F.min(F.when((F.col("stripping_index") >= F.col("p1")) & (F.col("error") > threshold), F.col("stripping_index")))
    stops = met.groupBy("clip_id", "n", "most", "p1").agg(F.coalesce(past, F.col("n")).alias("p2"))
    count = F.least(F.col("most"), F.greatest(F.col("p1"), F.col("p2"), F.floor(F.col("n") * proportion)))
    return ordered.join(stops.select("clip_id", count.alias("count")), "clip_id").withColumn("stripped", F.col("stripping_index") < F.col("count")).drop("count")
