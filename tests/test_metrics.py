from __future__ import annotations

import math

import pytest

from facetspark.operators.metrics import (best_epoch, confusion_counts, cross_entropy, item_accuracy,
                                          macro_metrics)

PAIRS = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "d")]


def test_confusion_counts_fixture(spark):
    df = spark.createDataFrame(PAIRS, "y string, p string")
    got = sorted(tuple(r) for r in confusion_counts(df, "y", "p").collect())
    assert got == [("a", 3, 2, 1), ("b", 1, 2, 1), ("c", 1, 0, 0), ("d", 0, 1, 0)]


def test_macro_metrics_fixture(spark):
    df = spark.createDataFrame(PAIRS, "y string, p string")
    r = macro_metrics(df, "y", "p").first()
    assert r.n == 5
    assert r.accuracy == pytest.approx(0.4)
    assert r.precision == pytest.approx(0.5)
    assert r.recall == pytest.approx(0.583333)
    assert r.f1 == pytest.approx(0.266667)


def test_macro_metrics_zero_division_and_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "b")], "y string, p string")
    r = macro_metrics(df, "y", "p", digits=None).first()
    # null == null counts as right for accuracy (pandas equality of None objects)
    assert r.accuracy == pytest.approx(2 / 3)
    # labels a (t=1,p=0 -> precision 1.0, recall 0) and b (1/1)
    assert r.precision == pytest.approx(1.0)
    assert r.recall == pytest.approx(0.5)


def test_item_accuracy_and_cross_entropy(spark):
    df = spark.createDataFrame([("x", "x", "y", "y"), ("x", "x", "y", "n"), ("x", None, "y", "y")],
                               "a string, pa string, b string, pb string")
    r = item_accuracy(df, [("a", "pa"), ("b", "pb")]).first()
    assert (r.n, r.item_accuracy) == (3, pytest.approx(1 / 3, abs=1e-6))
    p = spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "p double")
    ce = cross_entropy(p, "p", digits=None).first()
    assert ce.cross_entropy == pytest.approx((-math.log(0.5) - math.log(1e-6)) / 3)


def test_best_epoch_fixture(spark):
    m = spark.createDataFrame([("x", e + 1, s) for e, s in enumerate([0.2, 0.5, 0.5, 0.4, 0.6])],
                              "attr string, epoch int, score double")
    r = best_epoch(m, patience=2).first()
    assert r.best_epoch == 5 and r.best_score == pytest.approx(0.6)
    assert r.stop_epoch == 4
    assert r.best_epoch_at_stop == 2


@pytest.mark.parametrize("scores, patience, greater, expect", [
    # gaps between epoch numbers: three evaluations without improvement, not three epochs
    ([(1, .1), (5, .5), (9, .4), (10, .6)], 3, True, (10, 10, 10)),
    ([(1, .1), (5, .5), (9, .4), (10, .3), (30, .2), (31, .9)], 3, True, (31, 30, 5)),
    # a loss needs no starting value
    ([(1, 3.), (2, 2.), (3, 1.), (4, 1.5), (5, .5)], 10, False, (5, 5, 5)),
    ([(1, 3.), (2, 2.), (3, 2.), (4, 2.5), (5, .5)], 2, False, (5, 4, 2)),
    # a score that never beats 0
    ([(1, 0.), (2, 0.), (3, 0.)], 2, True, (1, 2, None)),
])
def test_early_stopping_counts_evaluations(spark, scores, patience, greater, expect):
    m = spark.createDataFrame([("x", e, s) for e, s in scores], "attr string, epoch int, score double")
    r = best_epoch(m, patience=patience, greater=greater).first()
    assert (r.best_epoch, r.stop_epoch, r.best_epoch_at_stop) == expect


def test_cross_entropy_of_probabilities(spark):
    p = spark.createDataFrame([([0.2, 0.8], 1), ([0.5, 0.5], 0), ([1.0, 0.0], 5)], "p array<double>, y int")
    ce = cross_entropy(p, "p", "y", digits=None).first()
    assert ce.cross_entropy == pytest.approx(-(math.log(0.8) + math.log(0.5) + math.log(1e-6)) / 3)


def test_best_epoch_lower_is_better(spark):
    m = spark.createDataFrame([("x", 1, 3.0), ("x", 2, 2.0), ("x", 3, 2.5), ("x", 4, 1.0)],
                              "attr string, epoch int, loss double")
    r = best_epoch(m, metric="loss", patience=10, greater=False, initial=None).first()
    assert (r.best_epoch, r.best_score, r.stop_epoch) == (4, 1.0, 4)
