"""Connected components of a graph that no machine holds: alternating stars, each round a written table.

Every round first points each larger neighbour of a node at the smallest node next to it (large star), then each node and its
smaller neighbours at the smallest of these (small star). Rounds go on until nothing changes; what is left are stars,
so each node's one edge names its component's smallest node. Minima are aggregated before they are joined back, so a hub with
very many edges is never gathered in one task; the join of a hub's edges with its one minimum can be split.

Before the first round and at the end of each, tasks of about ``BLOCK`` edges replace what they hold by the stars of its own components.
That keeps what is connected connected, however the edges are dealt, and makes rounds few: what fits one block needs none.

Links with a null are dropped, as are links of a node with itself; repeated links count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Edges that one task contracts at a time.
BLOCK = 1 << 16


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of n nodes, for edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _stars_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The stars of the components of these edges alone: hi for all nodes but the smallest, lo."""
    ends = [b.column(c) for c in ("hi", "lo") for b in held]
    codes = pa.concat_arrays(ends).dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    hi, lo = np.split(rank[codes.indices.to_numpy()], 2)
    root = local_roots(len(order), hi, lo)
    nodes = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([codes.dictionary.take(order.take(pa.array(x))) for x in (nodes, root[nodes])], ["hi", "lo"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 2 * BLOCK:
            yield _stars_of(held)
            held = []
    if held:
        yield _stars_of(held)


def _contract(edges: DataFrame, n: int) -> DataFrame:
    """About ``n`` edges (hi, lo), contracted within tasks of about BLOCK of them."""
    return edges.coalesce(max(1, -(-n // BLOCK))).mapInArrow(_contracted, edges.schema)


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (hi, lo), hi > lo. Large star with both ways, else small star."""
    near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if both_ways:
        near = near.unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    # Written, so the join with it is one of two plain exchanges, which adaptive execution can split at a hub.
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-minima")
    met = near.join(least, "u")
    if both_ways:
        out = met.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = met.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.filter("hi > lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of any orderable nodes: node and root, the smallest of its component, for all nodes but the roots."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    edges_n = now.count()
    now = materialize(_contract(now, edges_n), "contracted")
    while True:
        edges_n, nodes_n = now.agg(F.count("*"), F.countDistinct("hi")).first()
        # Stars: every node that is no root has one edge, and no root is a node with an edge.
        if edges_n == nodes_n and now.join(now.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        now = materialize(_contract(_star(materialize(_star(now, True), "large-star"), False), edges_n), "small-star")
