from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.operators.epochs import train_epochs
from facetspark.operators.metrics import best_epoch, cross_entropy
from facetspark.operators.models import fit_linear_head, score_linear_head
from facetspark.operators.sharded_softmax import fit_sharded_head, score_sharded_head


def _data(spark, n=300, d=6, classes=7, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(classes, d))[y] + rng.normal(size=(n, d))
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))],
                                 "id long, y int, v array<double>").repartition(3), x, y


def test_sharded_head_is_the_plain_head(spark):
    df, _, _ = _data(spark)
    head = fit_sharded_head(df, "v", "y", iterations=15, reg=0.05, shard_classes=3, block_rows=40)
    assert head.shards == 3 and head.size(2) == 1 and head.weights.count() == 3
    got = score_sharded_head(head, df, "v", label="y", block_rows=64)
    plain = score_linear_head(fit_linear_head(df, "v", "y", max_iter=100, reg=0.05, standardize=False), df, "v", keep=["y"])
    both = plain.select("id", F.col("prediction").alias("p"), F.array_max("probability").alias("q")).join(got, "id").collect()
    assert len(both) == 300 and np.mean([r.p == r.prediction for r in both]) >= 0.99
    assert max(abs(r.q - r.probability) for r in both) < 0.02
    assert abs(got.agg(F.avg("loss")).first()[0] - cross_entropy(plain, "probability", "y").first().cross_entropy) < 3e-3
    one, cut = (score_sharded_head(fit_sharded_head(df, "v", "y", iterations=2, shard_classes=s, block_rows=n), df, "v") for s, n in ((100, 1000), (2, 90)))
    a, b = ({r.id: (r.prediction, round(r.probability, 9)) for r in s.collect()} for s in (one, cut))
    assert one.columns == ["id", "prediction", "probability"] and a == b and len(a) == 300


def test_sharded_head_takes_odd_rows(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 3, [0.0, 1.0]), (3, None, [0.5, 0.5]), (4, 1, None)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    head = fit_sharded_head(df, "v", "y", iterations=5, reg=0.1, shard_classes=2)
    got = {r.id: r for r in score_sharded_head(head, df, "v", label="y").collect()}
    assert set(got) == {1, 2, 3} and got[1].prediction == 0 and got[2].prediction == 3 and got[3].loss is None
    empty = fit_sharded_head(df.limit(0), "v", "y", classes=4, shard_classes=3)
    assert empty.weights.count() == 2 and score_sharded_head(empty, df.limit(0), "v").count() == 0
    with pytest.raises(ValueError, match="labels"):
        fit_sharded_head(df, "v", "y", classes=2)


def test_more_coefficients_than_one_head_holds(spark, monkeypatch):
    from facetspark.operators import models

    classes, d = 9_000, 24
    monkeypatch.setattr(models, "MAX_COEFFICIENTS", classes * d - 1)
    rng = np.random.default_rng(0)
    rows = [(i, int(c), [float(v) for v in rng.normal(size=d)]) for i, c in enumerate(rng.permutation(classes)[:60])]
    rows.append((60, classes - 1, [0.0] * d))
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    with pytest.raises(ValueError, match="too many"):
        fit_linear_head(df, "v", "y")
    head = fit_sharded_head(df, "v", "y", iterations=2, reg=1e-3, shard_classes=2000)
    got = score_sharded_head(head, df, "v", label="y").collect()
    assert head.shards == 5 and head.size(4) == 1000 and len(got) == 61
    assert np.mean([r.loss for r in got]) < np.log(classes) and np.mean([r.prediction == rows[r.id][1] for r in got]) > 0.9


def test_epochs_are_adam_over_whole_batches(spark):
    df, x, y = _data(spark, 120, 4, 3)
    run = train_epochs(df, df, "v", "y", epochs=4, batch_rows=1000, rate=0.1, partitions=1)
    w, m, s = (np.zeros((3, 5)) for _ in range(3))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    losses, kept = [], []
    for t in range(1, 5):
        z = np.exp(x1 @ w.T)
        p = z / z.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        g = (p - np.eye(3)[y]).T @ x1 / len(y)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
        kept.append(w)
    table = run.history.orderBy("epoch").collect()
    assert np.allclose([r.train_loss for r in table], losses) and [r.n_train for r in table] == [120] * 4
    assert np.allclose(run.weights, kept[run.best - 1])
    assert max(table, key=lambda r: (r.val_f1, -r.epoch)).epoch == run.best
    assert best_epoch(run.history, "attr", "epoch", "val_f1").first().best_epoch == run.best
    z = np.exp(x1 @ kept[-1].T)
    assert abs(table[-1].val_loss - -np.log((z / z.sum(axis=1, keepdims=True))[np.arange(len(y)), y]).mean()) < 1e-9


def test_epochs_of_several_partitions_learn(spark):
    df, _, _ = _data(spark, 400, 5, 4)
    run = train_epochs(df.where("id % 4 > 0"), df.where("id % 4 = 0"), "v", "y", epochs=6, batch_rows=16, rate=0.02, partitions=20)
    table = run.history.orderBy("epoch").collect()
    assert table[-1].train_loss < table[0].train_loss < np.log(4) + 0.2 and table[-1].val_loss < table[0].val_loss
    assert {(r.n_train, r.n_val) for r in table} == {(300, 100)}


def test_epochs_stop_and_awkward_rows(spark):
    df, _, _ = _data(spark, 60, 3, 2)
    odd = df.unionByName(spark.createDataFrame([(900, None, [1.0, 1.0, 1.0]), (901, 1, None)], df.schema))
    run = train_epochs(odd, odd.limit(0), "v", "y", classes=2, epochs=3, partitions=1)
    assert [(r.n_train, r.n_val, r.val_f1) for r in run.history.collect()] == [(60, 0, None)] * 3 and run.best == 3
    still = train_epochs(df, df, "v", "y", epochs=9, rate=0.0, patience=2, partitions=1)
    assert still.epochs == 3 and still.best == 1
    with pytest.raises(ValueError, match="no training rows"):
        train_epochs(df.limit(0), df, "v", "y")
