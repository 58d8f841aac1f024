"""Evaluation: confusion counts, macro metrics, item accuracy, cross-entropy, best epoch.

Everything is a partial-then-final aggregation (map-side combine), so a label
or id holding a third of all rows costs one partial row per task, not a hot
reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _label_rows(df: DataFrame, y: str, p: str) -> DataFrame:
    """Each input row -> two rows: its truth label (t=1) and its predicted label (q=1)."""
    yv, pv = F.col(y).cast("string"), F.col(p).cast("string")
    return df.select(
        F.explode(F.array(
            F.struct(yv.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q"),
                     F.coalesce((yv == pv).cast("int"), F.lit(0)).alias("tp"),
                     yv.eqNullSafe(pv).cast("int").alias("ok")),
            F.struct(pv.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("tp"),
                     F.lit(0).alias("ok")),
        )).alias("e")).select("e.*")


def _per_label(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(label, n_true, n_pred, tp, ok)``; the NULL label is kept as its own group."""
    return (_label_rows(df, y, p).groupBy("label")
            .agg(F.sum("t").cast("bigint").alias("n_true"), F.sum("q").cast("bigint").alias("n_pred"),
                 F.sum("tp").cast("bigint").alias("tp"), F.sum("ok").cast("bigint").alias("ok")))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per label in union(truth, prediction): ``(label, n_true, n_pred, tp)``."""
    return _per_label(df, y, p).filter(F.col("label").isNotNull()).drop("ok")


def per_label_scores(counts: DataFrame, zero_division: float = 1.0) -> DataFrame:
    """Precision/recall/F1 per label; 0/0 takes ``zero_division`` (scikit-learn's convention)."""
    zd = F.lit(float(zero_division))
    prec = F.when(F.col("n_pred") == 0, zd).otherwise(F.col("tp") / F.col("n_pred"))
    rec = F.when(F.col("n_true") == 0, zd).otherwise(F.col("tp") / F.col("n_true"))
    den = F.col("n_true") + F.col("n_pred")
    f1 = F.when(den == 0, zd).otherwise(2.0 * F.col("tp") / den)
    return counts.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def macro_metrics(df: DataFrame, y: str, p: str, zero_division: float = 1.0,
                  digits: int | None = 6) -> DataFrame:
    """One row: ``n, accuracy, precision, recall, f1`` (macro over the label union).

    Two aggregations, no join: rows -> one row per label (partial aggregate,
    so a label holding a third of the rows costs one row per task), then a
    global aggregate over the labels. Accuracy counts NULL == NULL as right.
    """
    scores = per_label_scores(_per_label(df, y, p), zero_division)
    labelled = F.col("label").isNotNull()
    n = F.coalesce(F.sum("n_true"), F.lit(0)).cast("bigint")
    cols = {
        "accuracy": F.sum("ok") / F.sum("n_true"),
        "precision": F.avg(F.when(labelled, F.col("precision"))),
        "recall": F.avg(F.when(labelled, F.col("recall"))),
        "f1": F.avg(F.when(labelled, F.col("f1"))),
    }
    if digits is not None:
        cols = {k: F.round(v, digits) for k, v in cols.items()}
    return scores.agg(n.alias("n"), *[v.alias(k) for k, v in cols.items()])


def item_accuracy(df: DataFrame, pairs: Sequence[tuple[str, str]], digits: int | None = 6) -> DataFrame:
    """Share of rows whose every (truth, prediction) pair matches -> ``(n, item_accuracy)``."""
    ok = F.lit(True)
    for y, p in pairs:
        ok = ok & F.coalesce(F.col(y) == F.col(p), F.lit(False))
    acc = F.avg(ok.cast("double"))
    if digits is not None:
        acc = F.round(acc, digits)
    return df.agg(F.count(F.lit(1)).alias("n"), acc.alias("item_accuracy"))


def true_probability(probabilities: Column | str, label: Column | str) -> Column:
    """The probability given to class ``label`` (0-based); a label outside the classes gets 0."""
    return F.coalesce(F.get(_c(probabilities), _c(label).cast("int")), F.lit(0.0))


def cross_entropy(df: DataFrame, prob: str, label: str | None = None, eps: float = 1e-6, digits: int | None = 6) -> DataFrame:
    """Mean ``-ln(p)`` of the probability given to the true label, clipped to ``[eps, 1]``.

    ``prob`` holds that probability, or with ``label`` an array of class probabilities.
    """
    given = F.col(prob) if label is None else true_probability(prob, label)
    p = F.least(F.greatest(given, F.lit(eps)), F.lit(1.0))
    loss = F.avg(-F.log(p))
    if digits is not None:
        loss = F.round(loss, digits)
    return df.agg(F.count(F.lit(1)).alias("n"), loss.alias("cross_entropy"))


def head_report(scored: DataFrame, label: str, n_classes: int) -> DataFrame:
    """How a fitted head does on ``scored(prediction, probability, <label>)`` with 0-based labels, as one row.

    ``n`` rows; ``beats_majority``: accuracy is not below that of always answering
    the commonest label; ``beats_uniform``: cross-entropy is not above ln(classes);
    ``argmax_agrees``: every prediction is the first largest probability.
    """
    from facetspark.operators.models import argmax

    counts = scored.groupBy(F.col(label).alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == F.col("prediction")).cast("bigint")).alias("right"),
        F.sum(-F.log(F.greatest(true_probability("probability", label), F.lit(1e-12)))).alias("loss"),
        F.min((F.col("prediction") == argmax(F.col("probability"))).cast("int")).alias("agrees"))
    return counts.agg(
        F.sum("n").alias("n"), (F.sum("right") >= F.max("n")).alias("beats_majority"),
        (F.sum("loss") / F.sum("n") <= float(np.log(max(2, n_classes))) + 1e-9).alias("beats_uniform"),
        (F.min("agrees") == 1).alias("argmax_agrees"))


def best_epoch(metrics: DataFrame, by: str = "attr", epoch: str = "epoch", metric: str = "score",
               patience: int = 5, greater: bool = True, initial: float | str | None = "default") -> DataFrame:
    """Model selection over a ``(by, epoch, metric)`` table.

    An epoch improves when it strictly beats every earlier evaluation (and
    ``initial``, by default 0 for a score and nothing for a loss). Early
    stopping fires at the evaluation that is the ``patience``-th in a row
    without improvement; evaluations are counted, whatever their epoch numbers.
    Per ``by``: the overall best epoch, the stop epoch (last epoch if never
    stopped) and the best epoch up to the stop. Windows are per ``by`` over its
    evaluations only.
    """
    sgn = 1.0 if greater else -1.0
    if initial == "default":
        initial = 0.0 if greater else None
    in_order = Window.partitionBy(by).orderBy("_e")
    m = metrics.select(F.col(by), F.col(epoch).alias("_e"), F.col(metric).alias("_m"),
                       (F.col(metric) * F.lit(sgn)).alias("_s"))
    m = m.withColumn("_i", F.row_number().over(in_order))
    prev = F.max("_s").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    if initial is not None:
        prev = F.greatest(F.coalesce(prev, F.lit(initial * sgn)), F.lit(initial * sgn))
    m = m.withColumn("_imp", F.when(prev.isNull(), F.lit(True)).otherwise(F.col("_s") > prev))
    last = F.max(F.when(F.col("_imp"), F.col("_i"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("_fails", F.col("_i") - F.coalesce(last, F.lit(0)))
    whole = Window.partitionBy(by)
    stop = F.coalesce(F.min(F.when(F.col("_fails") >= patience, F.col("_e"))).over(whole), F.max("_e").over(whole))
    m = m.withColumn("stop_epoch", stop)
    order = F.struct(-F.col("_s"), F.col("_e"))
    counted = F.col("_imp") & (F.col("_e") <= F.col("stop_epoch"))
    return m.groupBy(by).agg(F.min_by("_e", order).alias("best_epoch"), F.min_by("_m", order).alias("best_score"),
                             F.first("stop_epoch").alias("stop_epoch"),
                             F.min_by(F.when(counted, F.col("_e")), F.when(counted, order)).alias("best_epoch_at_stop"))
