"""Connected components of an edge table, without collecting edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import Tables, drop, saved

SLAB = 1 << 19  # edges that a task contracts at a time, about
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slab of edges, one edge from each node to the smallest node of its component in the slab."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = roots(*(np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1)))
        leaf = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(root[leaf]), pa.array(nodes[leaf])], schema=_EDGE)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SLAB:
            yield star(held)
            held, size = [], 0
    if size:
        yield star(held)


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) longs, any order, repeats allowed.

    Each round contracts the edges inside its tasks to stars, hooks every node to its smallest neighbour (map-side minima,
    so a hub costs one row a task) and contracts the edges to the hooks; only edges between different hooks go on, so the
    table shrinks geometrically in practice, and a table that fits one slab ends in one round. The result is one of `tables`;
    those of the rounds are deleted as they go.
    """

    def contracted(found: DataFrame) -> DataFrame:
        return found.where("a <> b").select("a", "b").mapInArrow(_stars, "a long, b long")

    def hooked(found: DataFrame) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
        return contracted(found).select(ends.alias("e")).select("e.*").groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))

    edges = saved(contracted(edges))
    hooks = labels = tables.saved(hooked(edges))
    while True:
        left = hooks.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        right = hooks.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        moved = contracted(edges).join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        # an edge from a node to its hook leads from hook to hook as well: a -> c(a) becomes c(a) -> c(c(a))
        further = saved(contracted(moved))
        drop(edges)
        edges = further
        if edges.isEmpty():
            drop(edges)
            return labels
        hooks = tables.saved(hooked(edges))
        step = hooks.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = tables.saved(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
