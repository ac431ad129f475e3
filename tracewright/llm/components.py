"""Connected components of a link table by alternating star contractions; a table of few links is settled by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.scratch import discard, stash

MAX_ROUNDS = 60
FEW_LINKS = 1 << 19  # 8 MB of numbers; more are never brought to one task


def _tally(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return row[0], int(row[1])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest label the node sees, its own included."""
    sides = edges.select(F.col("hi").alias("at"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("at"), F.col("hi").alias("other")))
    least = sides.groupBy("at").agg(F.min("other").alias("m")).select("at", F.least("at", "m").alias("m"))
    return sides.where("other > at").join(least, "at").where("other != m").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def smallest_reachable(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, component of each) of the links between hi[i] and lo[i]: roots hook to the smallest root beside them."""
    nodes = np.unique(np.concatenate((hi, lo)))
    a, b = np.searchsorted(nodes, hi), np.searchsorted(nodes, lo)
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not np.array_equal(above := root[root], root):
            root = above
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _settled(edges: DataFrame) -> DataFrame:
    """(node, component) by one task that holds all of `edges`."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.zeros(0, np.int64)] * 2, *([c.to_numpy() for c in batch.columns] for batch in batches)]
        nodes, components = smallest_reachable(*map(np.concatenate, zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(components)], ["node", "component"])

    return edges.select("hi", "lo").coalesce(1).mapInArrow(per_partition, "node long, component long")


def connected_components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) for each node of `links` (src, dst), the component being its smallest node.

    Nodes are longs. Nulls and self links say nothing and are ignored; repeated links count once; an empty
    table gives an empty table. Each round is two aggregations and two joins on a node, so a hub that holds a
    large share of the links is pre-aggregated in the one and split by adaptive skew handling in the other. At most
    `few` links take no round: each round is some ten small jobs, whose plans, classes and threads the driver holds.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    edges = stash(links.where(src.isNotNull() & dst.isNotNull() & (src != dst)).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct(), "links")
    state = _tally(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] <= few:
            settled = stash(_settled(edges), "components")
            discard(edges)
            return settled
        contracted = stash(_small_star(_large_star(edges)), "stars")
        after = _tally(contracted)
        discard(edges)
        edges = contracted
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
