"""Connected components by randomised contraction, for graphs of any shape.

In each round every node takes the neighbour (or itself) that comes first in a pseudorandom order of that round; edges
are renamed and made distinct, so the expected number of nodes falls by a constant factor whatever the graph looks
like, a long chain or a star included. Every round is written to the shared checkpoint folder. Once no more than FEW
edges are left, which a task holds in some ten megabytes, one task joins their ends by union-find; the result is the
same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, hot_join

#: Edges that one task takes.
FEW = 200_000


def union_find(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of the component of each, by rounds of taking the least root."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    up = np.arange(len(nodes))
    while len(a):
        lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        apart = lo != hi
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(up, hi, lo)
        while not np.array_equal(far := up[up], up):
            up = far
    return nodes, nodes[up]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = union_find(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["now", "root"])


def _renamed(edges: DataFrame, to: DataFrame) -> DataFrame:
    half = hot_join(edges, to.select(F.col("node").alias("src"), F.col("next").alias("_s")), ["src"]).select(F.col("_s").alias("src"), "dst")
    return hot_join(half, to.select(F.col("node").alias("dst"), F.col("next").alias("_d")), ["dst"], counted=edges).select("src", F.col("_d").alias("dst"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (src long, dst long); component: the smallest node in it.

    Edges with a null end are no edges; loops only name their node; repeated edges count once. No edges: no nodes.
    """
    edges = edges.where("src is not null and dst is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    edges = checkpoint(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    rounds = 0
    while edges.count() > FEW:
        if labels is None:
            labels = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("now", F.col("node"))
            edges = edges.where("src <> dst")
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), F.col(c)), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select(F.col("src").alias("node"), order("dst").alias("o")).unionByName(edges.select(F.col("dst").alias("node"), order("src").alias("o")))
        to = both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", order("node")).alias("o")).select("node", F.col("o.v").alias("next"))
        to = checkpoint(to)
        new = _renamed(edges, to).where("src <> dst")
        edges = checkpoint(new.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        labels = checkpoint(hot_join(labels, to.withColumnRenamed("node", "now"), ["now"], "left").select("node", F.coalesce("next", "now").alias("now")))
        rounds += 1
    rest = edges.coalesce(1).mapInArrow(_whole, "now long, root long")
    if labels is None:
        return rest.select(F.col("now").alias("node"), F.col("root").alias("component"))
    # the root of a contracted node is no more than a name: its component's smallest node is found over all nodes
    named = checkpoint(hot_join(labels, rest, ["now"], "left").select("node", F.coalesce("root", "now").alias("now")))
    least = named.groupBy("now").agg(F.min("node").alias("component"))
    return hot_join(named, least, ["now"]).select("node", "component")
