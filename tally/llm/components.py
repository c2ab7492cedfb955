"""Connected components of an edge table (alternating large and small stars).

Each task first contracts the edges it holds, batch by batch, to stars
around the smallest node.  Then every round rewrites the edges so that each
node points at smaller ones: all larger neighbours of a node are linked to
its smallest neighbour, then all smaller ones.  The number of rounds grows
with the logarithm of the longest path, a round is two aggregations and two
joins on the edges, whose skewed nodes Spark can split, and no list of
neighbours is ever gathered.  Each round is frozen in the shared checkpoint
folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_frozen


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars around the smallest node."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]),
                              return_inverse=True)
        a, b = at[:batch.num_rows], at[batch.num_rows:]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[leaf]]), pa.array(nodes[leaf])], names=["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one centre and no centre has another."""
    twice = edges.groupBy("b").agg((F.min("a") != F.max("a")).alias("more")).where("more")
    chained = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return twice.select("b").unionByName(chained.select(F.col("a").alias("b"))).isEmpty()


def _star(both: DataFrame) -> DataFrame:
    """Rows (u, v, m): m is the smallest of u and its neighbours v."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for
    every node that some edge joins with another.  Nulls and loops are
    ignored."""
    edges = (edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b"))
    edges = cut_lineage(edges.mapInArrow(_contract, "a long, b long").distinct())
    while not _settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = (down.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
                 .unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        new = cut_lineage(small)
        drop_frozen(edges)
        edges = new
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct()
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return nodes.unionByName(roots)
