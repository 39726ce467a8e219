"""Connected components of an undirected edge list, by alternating large and small stars."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import cut
from traitgrid.session import ship_package

#: Links that one task contracts at a time.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as links of each node to the least of its component among them."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The links ``a, b`` of ``edges`` as ``u, v`` stars of what each task reads, hub
    ``v`` least, at most about ``chunk`` links at a time: the same components, in fewer
    and shorter chains, without a shuffle."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, n = [], 0
        for batch in chain(_each(batches), [None]):
            if batch is not None:
                held.append(batch)
                n += len(batch[0])
            if n and (batch is None or n >= chunk):
                u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)
                held, n = [], 0

    def _each(batches):
        for x in batches:
            yield [x.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)]

    ship_package(edges.sparkSession)
    return edges.mapInArrow(run, "u long, v long")


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v`` pairs with ``m``, the least of u and its v's. The minimum is
    pre-aggregated and written before it is joined back: a join straight on the
    aggregate could not be split, and a hub's pairs would meet in one task."""
    least = cut(pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of the edge
    columns ``a, b`` (long). Nodes without an edge to another node are absent.

    Each round is written to the shared folder, and what a task then reads of it is
    contracted; rounds go on until the edges are one
    star for each component, hub least (no round is spent on seeing that nothing
    changes any more)."""
    e = cut(contracted(edges.select("a", "b").filter("a != b"), chunk))
    while True:
        # a link that two tasks hold is no sign of an open node: parents are compared, not counted
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("hub"), F.lit(False).alias("is_hub")).union(
            e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("hub"), F.lit(True).alias("is_hub")))
        open_nodes = ends.groupBy("node").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi"), F.max("is_hub").alias("is_hub")).filter(
            "lo != hi or lo is not null and is_hub")
        if open_nodes.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        near = _with_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        e = cut(contracted(cut(small.filter("u != v").distinct()), chunk))
