"""Connected components of a graph given as a table of links, by large-star and small-star.

Each round leaves a written table in place of the one before it, so no lineage builds up and
nothing but counts reaches the driver. The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT, forget, written

MOST_ROUNDS = 60
#: Links of a node that make it a hub, at the least; with FREQUENT it bounds the number of hubs.
HUB_LEAST = 256


def _star(links: DataFrame, large: bool, n_links: int) -> DataFrame:
    """Each node's links, bent to the smallest node around it.

    Large star sees both directions and bends the links to larger neighbours; small star sees
    the smaller neighbours only. The minimum is an aggregate with partial sums. It is joined back
    by a shuffle for most nodes; those with at least 1 / FREQUENT of all links, at most FREQUENT
    nodes, are broadcast, so a hub's links stay where they are.
    """
    flipped = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = links.unionByName(flipped)
    if not large:
        around = around.filter("b <= a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    many = max(HUB_LEAST, -(-2 * n_links // FREQUENT))
    hubs = F.broadcast(least.filter(F.col("n") >= many).select("a", F.col("m").alias("hub_m")))
    marked = around.join(hubs, "a", "left")
    near_hubs = marked.filter("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    others = marked.filter("hub_m IS NULL").select("a", "b").join(least.filter(F.col("n") < many).select("a", "m"), "a")
    bent = near_hubs.unionByName(others).filter("b > a" if large else "true")
    bent = bent.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        bent = bent.unionByName(least.select("a", F.col("m").alias("b")))
    return bent.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node of ``links`` (columns a and b) that isn't the smallest of its component, and that smallest."""
    held = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before, n_links = None, held.count()
    for _ in range(MOST_ROUNDS):
        if not n_links:
            return held
        large = written(_star(held, True, n_links), "links-large")
        small = written(_star(large, False, n_links), "links")
        forget(held, large)
        held = small
        # The links are settled when every node hangs directly on a root and nothing has changed.
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return held
        before, n_links = state, state[0]
    raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest of its component) that connect what the links (a[i], b[i]) connect."""
    if not len(a):
        return a, b
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(values))
    return values[other], values[label[other]]
