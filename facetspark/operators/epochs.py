"""A linear head trained by epochs of mini-batches, with a table of losses per epoch.

An epoch is one Spark job: every partition goes through its rows in a new hashed
order, in mini-batches with Adam steps from the epoch's common weights, and the
partitions' weights are averaged by their row numbers, ``FAN`` at a time. After
each epoch the validation rows are scored in a second job. The table (attr,
epoch, train and val loss, accuracy, macro F1) is what
:func:`facetspark.operators.metrics.best_epoch` selects from, and the weights of
the best epoch are kept (a copy, not the last ones).

The weights (classes x features) are small enough for the driver; heads beyond
``MAX_COEFFICIENTS`` are for :mod:`facetspark.operators.sharded_softmax`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.operators import metrics as MT
from facetspark.operators.models import MAX_COEFFICIENTS
from facetspark.session import store

FAN = 16  # partitions' weights averaged by one task
_STATE = "part long, n long, loss double, steps long, state binary"
_BETAS, _TINY = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class EpochRun:
    """``history``: (attr, epoch, n_train, train_loss, n_val, val_loss, val_accuracy, val_f1); ``weights``: those of ``best``."""

    history: DataFrame
    weights: np.ndarray  # classes x (features + 1), the bias last
    best: int | None
    epochs: int


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w[:, :-1].T + w[:, -1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _stack(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _epoch(train: DataFrame, state: np.ndarray, steps: int, epoch: int, classes: int, dims: int, batch_rows: int, rate: float, seed: int) -> tuple[np.ndarray, int, int, float]:
    """Averaged (weights, two Adam moments), steps taken, rows and summed loss after one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, second = state.copy()
        done, n, loss = steps, 0, 0.0

        def one(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal w, first, second, done, n, loss
            p = _probabilities(x, w)
            at = np.arange(len(y)), y
            loss -= float(np.log(np.maximum(p[at], 1e-300)).sum())
            p[at] -= 1
            slope = np.hstack([p.T @ x, p.sum(axis=0)[:, None]]) / len(y)
            done, n = done + 1, n + len(y)
            first = _BETAS[0] * first + (1 - _BETAS[0]) * slope
            second = _BETAS[1] * second + (1 - _BETAS[1]) * slope * slope
            w = w - rate * (first / (1 - _BETAS[0] ** done)) / (np.sqrt(second / (1 - _BETAS[1] ** done)) + _TINY)

        x, y = np.zeros((0, dims)), np.zeros(0, np.int64)
        for batch in batches:
            x, y = np.vstack([x, _stack(batch.column(0), dims)]), np.concatenate([y, batch.column(1).to_numpy()])
            while len(y) >= batch_rows:
                one(x[:batch_rows], y[:batch_rows])
                x, y = x[batch_rows:], y[batch_rows:]
        if len(y):
            one(x, y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([loss]), pa.array([done]),
                                              pa.array([np.stack([w, first, second]).tobytes()], pa.binary())], names=["part", "n", "loss", "steps", "state"])

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        n = t["n"].to_numpy()
        total = sum(k * np.frombuffer(s.as_py()) for k, s in zip(n, t["state"], strict=True))
        return pa.table({"part": t["part"][:1], "n": [int(n.sum())], "loss": [float(t["loss"].to_numpy().sum())],
                         "steps": [int(t["steps"].to_numpy().max())], "state": pa.array([(total / n.sum()).tobytes()], pa.binary())})

    order = F.xxhash64("id", F.lit(seed), F.lit(epoch))
    parts = train.sortWithinPartitions(order, "id").select("x", "y").mapInArrow(run, _STATE)
    parts = store(parts, "epoch")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(average, _STATE)
    r = parts.first()
    return np.frombuffer(r.state).reshape(state.shape).copy(), r.steps, r.n, r.loss


def predict(df: DataFrame, weights: np.ndarray, features: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``prediction`` (first greatest) and ``probabilities`` of every row's vector."""
    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(_probabilities(np.stack(x.to_numpy()).astype(np.float64), weights))) if len(x) else pd.Series([], dtype=object)

    from facetspark.operators.models import argmax

    scored = df.select(*keep, score(F.col(features)).alias("probabilities"))
    return scored.withColumn("prediction", argmax(F.col("probabilities")))


def train_epochs(train: DataFrame, val: DataFrame, features: str, label: str, classes: int | None = None, attr: str = "label", epochs: int = 5,
                 batch_rows: int = 512, rate: float = 3e-3, patience: int | None = 5, partitions: int | None = None, id_col: str = "id",
                 seed: int = 1) -> EpochRun:
    """Train on ``train`` for at most ``epochs`` epochs, judging every epoch on ``val``.

    Labels are 0-based class numbers; rows with a null label or vector are left out of
    either side. ``partitions`` deals the training rows by a hash of the id (None: as read);
    the fit depends on it, as each partition steps by itself within an epoch. The best epoch has
    the greatest macro F1, the first of equals; training stops after ``patience`` epochs without a
    better one. Without validation rows the scores are null and the last epoch is kept.
    """
    usable = lambda d: d.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(id_col).alias("id"), F.transform(F.col(features), lambda c: c.cast("double")).alias("x"), F.col(label).cast("long").alias("y"))
    rows = usable(train)
    rows = store(rows.repartition(partitions, "id") if partitions else rows, "train")
    held = store(usable(val), "val")
    r = rows.agg(F.max("y").alias("top"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("short")).first()
    if r["top"] is None:
        raise ValueError("no training rows with a label and a vector")
    classes, dims = classes or int(max(r["top"], held.agg(F.max("y")).first()[0] or 0)) + 1, r["d"]
    if r["short"] != dims or classes * (dims + 1) > MAX_COEFFICIENTS:
        raise ValueError(f"vectors of {r['short']} to {dims} entries, {classes} classes")
    state, steps = np.zeros((3, classes, dims + 1)), 0
    best, kept, table, since = None, state[0], [], 0
    for epoch in range(1, epochs + 1):
        state, steps, n, loss = _epoch(rows, state, steps, epoch, classes, dims, batch_rows, rate, seed)
        scored = predict(held, state[0], "x", ("y",)).select("y", "prediction", F.get("probabilities", F.col("y").cast("int")).alias("p"))
        scored = store(scored, "scored")
        m, loss_row = MT.macro_metrics(scored, "y", "prediction", digits=None).first(), MT.cross_entropy(scored, "p", digits=None).first()
        n_val, scores = (m.n, (loss_row.cross_entropy, m.accuracy, m.f1)) if m.n else (0, (None, None, None))
        table.append((attr, epoch, n, loss / n, n_val, *scores))
        if best is None or not n_val or scores[2] > best[1]:
            best, kept, since = (epoch, scores[2]), state[0].copy(), 0
        else:
            since += 1
            if patience is not None and since >= patience:
                break
    history = train.sparkSession.createDataFrame(
        table, "attr string, epoch long, n_train long, train_loss double, n_val long, val_loss double, val_accuracy double, val_f1 double")
    return EpochRun(history, kept, best[0] if best else None, len(table))
