"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


#: Edges that one task holds at a time: 16 MB of pairs.
TASK_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of these edges: (node, smallest node it is connected with)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # The labels' own labels fall too, so that chains halve.
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges, replaced by one from each of its nodes to the
    smallest that it reaches inside the batch."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        node, root = roots(a, b)
        apart = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], names=["a", "b"])


def contract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for all edges of a task."""
    held = list(batches)
    if held:
        yield from contract(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes of edges (a, b: long, not null), the
    component being its smallest node.

    Tasks of up to TASK_EDGES edges each replace these by one from each node to the
    smallest that it reaches there. Where one task suffices that is all; else,
    alternating large and small stars: first every larger neighbour of a node
    is joined to the node's smallest neighbour, then every smaller one and the
    node itself. The edges are a forest of stars when nothing changes. A node's
    smallest neighbour is an aggregate, taken per task first; the edges of a node with
    very many stream through one join task as pairs of numbers, and are never held.
    Each round is a written table.
    """
    found = scratch.keep(edges.where("a <> b").mapInArrow(contract, "a long, b long"))
    tasks = max(1, -(-found.count() // TASK_EDGES))
    edges = scratch.keep(found.repartition(tasks).mapInArrow(contract_task, "a long, b long"))
    number, state = scratch.made, None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now a > b in each row.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges, last = scratch.keep(small), number
        number = scratch.made
        scratch.drop(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
