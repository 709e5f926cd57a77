"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch, replace the edges by stars around the smallest node of each local component."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        label, (x, y) = np.arange(len(nodes)), ends.reshape(2, -1)
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        apart = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart], pa.int64()), pa.array(nodes[label[apart]], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's greater (large) or lesser (small) neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # written before it is joined, so that a hub's side of the join can be split
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = both.join(least, "u")
    if large:
        return out.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (two long columns); component is its least node.

    Loops, repeated and empty edge tables are allowed.  Every round is a few joins over edges that only
    shrink, and is checkpointed; no round brings edges to the driver.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    now = cut(now.mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    while True:
        now = cut(_star(_star(now, large=True), large=False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    centres = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
