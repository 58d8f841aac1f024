"""A softmax head for very many classes: its weights are a table of class shards, never one matrix.

Rows are packed into blocks, classes into shards. A round of training takes three steps,
all of them over (block, shard) pairs whose two matrices a task holds:

1. every pair gives each row's greatest score and the sum of exponentials in the shard,
   which are combined over the shards into the row's log normaliser;
2. every pair turns scores and normalisers into the shard's part of the gradient, which
   is added up over the blocks in rounds of ``FAN``;
3. every shard's weights take an accelerated step along its gradient.

So the fit is the plain softmax regression, class shard by class shard. Steps are scaled
by the inverse of the bound 1/2 X'X on the curvature (features x features, on the driver).
The weights of a round are stored; a lost task reads the stored round again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.indexing import zip_index
from facetspark.session import store

FAN = 16  # partial gradients added by one task
_BLOCK = "block long, n int, ids array<long>, x binary, y binary"
_WEIGHTS = "shard long, weights binary, last binary"


@dataclass(frozen=True)
class ShardedHead:
    """``weights``: (shard, weights, last) with ``shard_classes`` rows of ``dims + 1`` doubles each, the bias last."""

    weights: DataFrame
    classes: int
    dims: int
    shard_classes: int

    @property
    def shards(self) -> int:
        return -(-self.classes // self.shard_classes)

    def size(self, shard: int) -> int:
        return min(self.shard_classes, self.classes - shard * self.shard_classes)


def row_blocks(df: DataFrame, features: str, label: Column, id_col: str, dims: int, block_rows: int) -> tuple[DataFrame, int]:
    """Consecutive rows of every partition packed into matrices of ``block_rows`` rows with a column of ones, stored;
    blocks are numbered 0, 1, 2 and so on, and counted."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, done = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, done
            t = pa.Table.from_batches(held)
            x = np.ones((len(t), dims + 1))
            x[:, :dims] = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            block = (TaskContext.get().partitionId() << 32) + done
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(t)], pa.int32()), pa.array([t["id"].to_pylist()], pa.list_(pa.int64())),
                                              pa.array([x.tobytes()], pa.binary()), pa.array([t["y"].to_numpy().astype(np.int64).tobytes()], pa.binary())],
                                             names=["block", "n", "ids", "x", "y"])
            held, count, done = [], 0, done + 1
            return out

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, block_rows - count)
                held.append(batch.slice(0, take))
                count, batch = count + take, batch.slice(take)
                if count == block_rows:
                    yield flush()
        if count:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(features), lambda c: c.cast("double")).alias("x"), label.cast("long").alias("y"))
    blocks = store(rows.mapInArrow(pack, _BLOCK), "blocks")
    places = store(zip_index(blocks.select("block"), ["block"], "place"), "places")
    return blocks.join(places, "block").withColumn("block", F.col("place")).drop("place"), places.count()


def _x(t: pa.Table) -> np.ndarray:
    return np.frombuffer(t["x"][0].as_py()).reshape(t["n"][0].as_py(), -1)


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def _pairs(blocks: DataFrame, head: ShardedHead, n_blocks: int):
    """Blocks and weights cogrouped by (block, shard): each side is sent once for every part of the other."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("shard", each(head.shards))
    right = head.weights.where(F.lit(n_blocks > 0)).withColumn("block", each(max(1, n_blocks)))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))


def _normalisers(blocks: DataFrame, head: ShardedHead, n_blocks: int, ahead: float) -> DataFrame:
    """``block, log_sum``: every row's log normaliser over all classes at the point ``ahead`` of the weights."""
    dims = head.dims

    def scores(b: pa.Table, w: pa.Table) -> pa.Table:
        z = _x(b) @ _point(w, dims, ahead).T
        top = z.max(axis=1)
        return pa.table({"block": b["block"], "top": _bytes(top), "total": _bytes(np.exp(z - top[:, None]).sum(axis=1))})

    def combine(t: pa.Table) -> pa.Table:
        top = np.array([np.frombuffer(v) for v in t["top"].to_pylist()])
        total = np.array([np.frombuffer(v) for v in t["total"].to_pylist()])
        most = top.max(axis=0)
        return pa.table({"block": t["block"][:1], "log_sum": _bytes(most + np.log((total * np.exp(top - most)).sum(axis=0)))})

    found = _pairs(blocks, head, n_blocks).applyInArrow(scores, "block long, top binary, total binary")
    return found.groupBy("block").applyInArrow(combine, "block long, log_sum binary")


def _point(w: pa.Table, dims: int, ahead: float) -> np.ndarray:
    now, last = (np.frombuffer(w[c][0].as_py()).reshape(-1, dims + 1) for c in ("weights", "last"))
    return now + ahead * (now - last)


def _round(blocks: DataFrame, head: ShardedHead, n_blocks: int, rows: int, scale: np.ndarray, reg: float, ahead: float) -> DataFrame:
    dims, size = head.dims, head.shard_classes
    penal = np.append(np.full(dims, reg), 0.0)  # the bias is free
    normal = blocks.join(_normalisers(blocks, head, n_blocks, ahead), "block")

    def gradient(b: pa.Table, w: pa.Table) -> pa.Table:
        x, point = _x(b), _point(w, dims, ahead)
        y, shard = np.frombuffer(b["y"][0].as_py(), np.int64), b["shard"][0].as_py()
        p = np.exp(x @ point.T - np.frombuffer(b["log_sum"][0].as_py())[:, None])
        own = np.flatnonzero((y >= shard * size) & (y < shard * size + len(point)))
        p[own, y[own] - shard * size] -= 1
        return pa.table({"shard": b["shard"], "part": b["block"], "sums": _bytes(p.T @ x)})

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = np.frombuffer(t["sums"][0].as_py()).copy()
        for i in range(1, len(t)):
            total += np.frombuffer(t["sums"][i].as_py())
        return pa.table({"shard": t["shard"][:1], "part": t["part"][:1], "sums": _bytes(total)})

    sums = _pairs(normal, head, n_blocks).applyInArrow(gradient, "shard long, part long, sums binary")
    left = n_blocks
    while left > 1:
        left = -(-left // FAN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("shard", "part").applyInArrow(add, "shard long, part long, sums binary")

    def step(w: pa.Table, g: pa.Table) -> pa.Table:
        point = _point(w, dims, ahead)
        slope = np.frombuffer(g["sums"][0].as_py()).reshape(point.shape) / rows + point * penal
        return pa.table({"shard": w["shard"], "weights": _bytes(point - slope @ scale), "last": w["weights"]})

    return store(head.weights.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(step, _WEIGHTS), "weights")


def fit_sharded_head(df: DataFrame, features: str, label: str, classes: int | None = None, iterations: int = 25, reg: float = 0.0,
                     id_col: str = "id", shard_classes: int = 4096, block_rows: int = 4096) -> ShardedHead:
    """Softmax regression of ``label`` (0-based class numbers) on ``features``, with the weights in shards of ``shard_classes``.

    Rows with a null label or vector are left out; all vectors must have one length. ``classes``
    defaults to the greatest label and one. A task holds a block, a shard and their scores:
    (block_rows + shard_classes) x dims + block_rows x shard_classes doubles. ``reg`` is the L2
    penalty on the weights without the bias.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    r = rows.agg(F.max(label).alias("top"), F.min(label).alias("least"), F.max(F.size(features)).alias("d"), F.min(F.size(features)).alias("short"),
                 F.count(F.lit(1)).alias("n")).first()
    classes = int(r["top"] + 1) if classes is None and r["n"] else int(classes or 1)
    if r["n"] and (r["d"] != r["short"] or not 0 <= r["least"] <= r["top"] < classes):
        raise ValueError(f"vectors of {r['short']} to {r['d']} entries, labels {r['least']} to {r['top']} of {classes} classes")
    dims = r["d"] or 1
    blocks, n_blocks = row_blocks(rows, features, F.col(label), id_col, dims, block_rows)
    spark = df.sparkSession
    n_shards = -(-classes // shard_classes)
    zero = F.udf(lambda s: b"\0" * (8 * (dims + 1) * min(shard_classes, classes - s * shard_classes)), "binary")
    start = spark.range(n_shards).select(F.col("id").alias("shard"), zero("id").alias("weights"))
    head = ShardedHead(store(start.withColumn("last", F.col("weights")), "weights"), classes, dims, shard_classes)
    if not r["n"]:
        return head
    gram = _gram(blocks, dims) / r["n"]
    curve = gram / 2 + np.diag(np.append(np.full(dims, reg), 0.0)) + 1e-9 * np.trace(gram) * np.eye(dims + 1)
    values, axes = np.linalg.eigh(curve)
    scale = (axes / values) @ axes.T
    for i in range(iterations):
        ahead = i / (i + 3)
        head = ShardedHead(_round(blocks, head, n_blocks, r["n"], scale, reg, ahead), classes, dims, shard_classes)
    return head


def _gram(blocks: DataFrame, dims: int) -> np.ndarray:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.frombuffer(x.as_py()).reshape(n, -1)
                total += m.T @ m
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "v"])

    # as many cells as features squared, whatever the rows: added up per cell
    cells = blocks.select("n", "x").mapInArrow(one, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims + 1) ** 2)
    out[cells["cell"]] = cells["v"]
    return out.reshape(dims + 1, dims + 1)


def score_sharded_head(head: ShardedHead, df: DataFrame, features: str, id_col: str = "id", label: str | None = None, block_rows: int = 4096) -> DataFrame:
    """``id, prediction, probability`` of every row with a vector; with ``label`` also ``loss``, minus the log of its probability.

    Ties go to the lower class. ``probability`` is the predicted class's. A null label, or one outside the classes, has a null loss.
    """
    rows = df.where(F.col(features).isNotNull())
    blocks, n_blocks = row_blocks(rows, features, F.coalesce(F.col(label), F.lit(-1)) if label else F.lit(-1), id_col, head.dims, block_rows)
    dims, size = head.dims, head.shard_classes

    def scores(b: pa.Table, w: pa.Table) -> pa.Table:
        z = _x(b) @ _point(w, dims, 0.0).T
        y, shard = np.frombuffer(b["y"][0].as_py(), np.int64), b["shard"][0].as_py()
        top = z.argmax(axis=1)
        value = z[np.arange(len(z)), top]
        own = np.full(len(z), np.nan)
        here = np.flatnonzero((y >= shard * size) & (y < shard * size + z.shape[1]))
        own[here] = z[here, y[here] - shard * size]
        return pa.table({"block": b["block"], "shard": b["shard"], "ids": b["ids"], "top": _bytes(value), "best": _bytes(top.astype(np.int64) + shard * size),
                         "total": _bytes(np.exp(z - value[:, None]).sum(axis=1)), "own": _bytes(own)})

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        top, total, own = (np.array([np.frombuffer(v) for v in t[c].to_pylist()]) for c in ("top", "total", "own"))
        best = np.array([np.frombuffer(v, np.int64) for v in t["best"].to_pylist()])
        first, most = top.argmax(axis=0), top.max(axis=0)
        norm = most + np.log((total * np.exp(top - most)).sum(axis=0))
        own = np.where(np.isnan(own).all(axis=0), np.nan, np.nansum(own, axis=0))
        loss = norm - own
        return pa.table({"id": pa.array(t["ids"][0].as_py(), pa.int64()), "prediction": best[first, np.arange(len(first))],
                         "probability": np.exp(most - norm), "loss": pa.array(loss, mask=np.isnan(loss))})

    found = _pairs(blocks, head, n_blocks).applyInArrow(scores, "block long, shard long, ids array<long>, top binary, best binary, total binary, own binary")
    out = found.groupBy("block").applyInArrow(combine, "id long, prediction long, probability double, loss double")
    return out.withColumnRenamed("id", id_col) if label else out.drop("loss").withColumnRenamed("id", id_col)
