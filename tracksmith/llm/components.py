"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.llm.common import discard, materialize


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links (a[k], b[k]) among nodes 0..n-1 that keep the same components.

    Of links that join the same two parts the first in the arrays wins, so sorting the input
    by preference makes preferred links stay. At most n-1 are returned.
    """
    label = np.arange(n)
    live = np.arange(len(a))
    kept = []
    while len(live):
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        _, first = np.unique(high, return_index=True)  # each part hooks onto one smaller part: no cycle
        kept.append(live[first])
        label[high[first]] = low[first]
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each round points all neighbours of a node at the smallest node it knows, so a chain
    shrinks geometrically and a star is final. Rounds are written to the shared folder; only
    two checksums reach the driver. Links with a null end and self-links are ignored.
    """
    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    )
    now = materialize(edges.distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
        large = both.join(least, "u").where("v > u").select(F.col("root").alias("u"), "v").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("root"))
        small = large.join(lowest, "v").where("u <> root").select(F.col("root").alias("u"), F.col("u").alias("v"))
        after = materialize(small.union(lowest.select(F.col("root").alias("u"), "v")).distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
