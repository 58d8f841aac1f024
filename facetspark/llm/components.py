"""Connected components of an edge table, by local contraction and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

LOCAL_EDGES = 1 << 20  # that a task contracts by itself


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: the smallest node that a task's own edges reach, for every other node of theirs."""
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes = pc.unique(pa.chunked_array(table["a"].chunks + table["b"].chunks))
    nodes = nodes.take(pc.sort_indices(nodes))
    above = list(range(len(nodes)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for i, j in zip(*(pc.index_in(table[c], nodes).to_pylist() for c in ("a", "b")), strict=True):
        i, j = root(i), root(j)
        above[max(i, j)] = min(i, j)
    roots = [root(i) for i in range(len(nodes))]
    hung = [i for i, r in enumerate(roots) if r != i]
    out = pa.table({"a": nodes.take(pa.array(hung, pa.int64())), "b": nodes.take(pa.array([roots[i] for i in hung], pa.int64()))})
    yield from out.to_batches(max_chunksize=1 << 16)


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node reachable, for every node of an edge.

    First every task replaces its own edges, ``local_edges`` at most, by a star for each
    component they form. Up to that many edges one task does it all, and the driver, whose
    memory every query it plans adds to, plans one pass instead of five queries a round. More
    edges are dealt evenly to as many tasks as they need, and rounds over the stars join what
    the tasks found. Each round hangs larger neighbours under the smallest one (large star),
    then smaller ones (small star); rounds follow the logarithm of the longest path. Only
    minima are grouped, so a node with any number of edges is pre-aggregated, and the joins
    on it can be split. Every step is written to the shared folder. Self edges and nulls are
    left out; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    tasks = -(-e.count() // local_edges)
    if tasks:
        kind = e.schema["a"].dataType.simpleString()
        e = e.coalesce(1) if tasks == 1 else e.repartition(tasks)
        e = stored(e.mapInArrow(_forest, f"a {kind}, b {kind}"), "forest")
    state = _state(e) if tasks > 1 else (0,)
    while state[0]:
        both = e.union(e.select("b", "a"))
        # minima are stored, so that the join's sides are plain shuffles and Spark can split a hot node's edges
        low = stored(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")), "minima")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "minima")
        small = large.join(low, "a")
        new = small.select("a", F.col("low").alias("b")).union(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        e = stored(new, "edges")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
