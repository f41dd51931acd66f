"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the least node reachable.

    Each round replaces a node's edges by edges to its least neighbour, with a
    map-side minimum per node and an equi-join, so a hub with any number of
    neighbours is neither gathered in one task nor expanded into pairs: AQE
    splits the join's large side. Rounds grow with the logarithm of the longest
    path; each round's edges are written to the shared checkpoint folder. Null
    ends and loops are ignored. Duplicate edges are harmless.
    """
    e = (
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = cut(e)
    before = _digest(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Forest:
    """Keeps of the links that it is given those that connect what wasn't connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            one, two = self.label[a], self.label[b]
            apart = one != two
            if not apart.any():
                return
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            high, first = np.unique(np.maximum(one, two), return_index=True)
            self.links.append((a[first], b[first]))
            root = np.arange(len(self.label))
            root[high] = np.minimum(one, two)[first]  # each label hangs on a lesser one: no rings
            while (root[root] != root).any():
                root = root[root]
            self.label = root[self.label]
