"""Connected components by alternating large-star and small-star rounds.

Each round is a few shuffles with map-side aggregation; between rounds the edges
are a table in the shared folder.  A node of any degree is fine: minima are
pre-aggregated, and the joins have plain shuffled sides that adaptive execution
can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import Scratch, lean


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (node, smallest node) per component of the links."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    on = low != np.arange(len(nodes))
    return nodes[on], nodes[low[on]]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.select("u", F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("x"))).groupBy("u").agg(F.least(F.min("x"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _in_one(batches):
    """The stars of all edges of a task."""
    held = [np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]) for b in batches]
    node, root = forest(*np.concatenate([np.zeros((2, 0), dtype=np.int64), *held], axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", few: int = 0) -> DataFrame:
    """``edges``: columns ``u`` and ``v`` (long), any direction, repeats and loops allowed.

    Returns ``node`` and ``root`` (the smallest node reachable) for every node that has
    an edge to another one and isn't itself the root.  No edges: no rows.
    Up to ``few`` different edges are joined up in one task, which spares the driver the rounds' plans and tasks; more take the rounds.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(clean, f"{name}0")
    if few and e.count() <= few:
        return scratch.save(e.coalesce(1).mapInArrow(lean(_in_one), "node long, root long"), f"{name}_stars")
    state, step = None, 0
    while True:
        n, check, roots = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if n == 0 or (n, check) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, step = (n, check), step + 1
        new = scratch.save(_small_star(_large_star(e)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        e = new
