"""Label vocabularies: distinct labels -> dense indexes, encode and decode.

The vocabulary is a DataFrame ``(attr, label, idx)``. Joins against it are
left to the optimizer: AQE turns them into broadcast hash joins at run time
when the measured vocabulary is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
and keeps a shuffle join when a vocabulary is too large to ship.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import MISSING_LABEL
from facetspark.operators.indexing import dense_index
from facetspark.session import store


def unpivot_labels(df: DataFrame, attrs: Sequence[str], id_col: str | None = "id") -> DataFrame:
    """Wide label columns -> long ``(id, attr, label)``."""
    ids = [id_col] if id_col else []
    return df.select(*ids, *[F.col(a).cast("string").alias(a) for a in attrs]) \
             .unpivot(ids, list(attrs), "attr", "label")


def build_vocab(labels: DataFrame, attrs: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Per attribute: sorted distinct labels -> ``idx`` 0..n-1 (sorted, so stable across runs)."""
    long = unpivot_labels(labels, attrs, None)
    if exclude:
        long = long.filter(~F.col("label").isin(list(exclude)))
    return dense_index(long, "attr", "label", "idx")


def label_cardinality(labels: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """``(attr, n_labels)``: distinct labels per attribute, counted without building an index."""
    long = unpivot_labels(labels, attrs, None).where(F.col("label").isNotNull()).distinct()
    return long.groupBy("attr").agg(F.count(F.lit(1)).alias("n_labels"))


SKETCH_BITS = 12  # 2**12 registers: a relative standard error of 1.04 / 64 = 1.6 %


def label_sketches(labels: DataFrame, attrs: Sequence[str], by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """``(*by, attr, sketch)``: a HyperLogLog sketch of the distinct labels of every attribute in every group.

    A sketch is at most some 2**``bits`` bytes whatever it counted, so the table can be stored and
    sketches of more rows, another split or another day merged in later.
    """
    cols = [F.col(a).cast("string").alias(a) for a in attrs]
    long = labels.select(*by, *cols).unpivot(list(by), list(attrs), "attr", "label").where(F.col("label").isNotNull())
    return long.groupBy(*by, "attr").agg(F.hll_sketch_agg("label", F.lit(bits)).alias("sketch"))


def merged_cardinality(sketches: DataFrame, by: Sequence[str] = ("attr",)) -> DataFrame:
    """``(*by, n_estimated)`` of the union of each group's sketches: off by more than 3 x 1.04 / sqrt(2**bits) about once in 400."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimated"))


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Three relative standard errors of a sketch."""
    return 3 * 1.04 / 2 ** (bits / 2)


def drop_missing(df: DataFrame, attr: str, missing: str = MISSING_LABEL, unless: Column | None = None) -> DataFrame:
    """Drop rows labelled ``missing``; a NULL label is kept (``<=>``, not ``<>``).
    Rows where ``unless`` holds are always kept (the test split keeps its ``na`` rows)."""
    keep = ~F.col(attr).eqNullSafe(F.lit(missing))
    return df.filter(keep if unless is None else (keep | unless))


def compact_vocab(vocab: DataFrame, missing: str = MISSING_LABEL, broadcast_attrs: int = 50_000) -> DataFrame:
    """Remove ``missing`` from a vocabulary and shift the indexes above it down by one.

    The rows to remove are at most one per attribute; up to ``broadcast_attrs``
    of them are broadcast, so a large attribute is not one join key's reducer.
    """
    na = store(vocab.filter(F.col("label") == missing)
               .select("attr", F.col("idx").alias("_na_idx")), "missing")
    na = F.broadcast(na) if na.limit(broadcast_attrs + 1).count() <= broadcast_attrs else na
    kept = vocab.filter(F.col("label") != missing).join(na, "attr", "left")
    return kept.withColumn(
        "idx", F.when(F.col("_na_idx").isNotNull() & (F.col("idx") > F.col("_na_idx")), F.col("idx") - 1)
        .otherwise(F.col("idx"))).drop("_na_idx")


def encode_labels(df: DataFrame, vocab: DataFrame, attrs: Sequence[str], id_col: str = "id",
                  unknown: str = "null") -> DataFrame:
    """Long ``(id, attr, label, idx)``; unseen labels -> NULL, 0 (``'zero'``) or dropped (``'drop'``)."""
    long = unpivot_labels(df, attrs, id_col)
    how = "inner" if unknown == "drop" else "left"
    out = long.join(vocab.select("attr", "label", "idx"), ["attr", "label"], how)
    if unknown == "zero":
        out = out.withColumn("idx", F.coalesce(F.col("idx"), F.lit(0).cast("bigint")))
    return out.select(id_col, "attr", "label", "idx")


def map_labels(df: DataFrame, vocab: DataFrame, attr: str, out_col: str = "output",
               unknown: str = "null") -> DataFrame:
    """Wide form of :func:`encode_labels` for one attribute: adds ``out_col`` = index of ``df[attr]``.

    ``unknown='zero'`` is the reference's behaviour (an unseen label silently
    becomes class 0); ``'null'`` keeps it visible; ``'drop'`` removes the row.
    """
    v = vocab.filter(F.col("attr") == attr).select(F.col("label").alias(attr), F.col("idx").alias(out_col))
    out = df.join(v, attr, "inner" if unknown == "drop" else "left")
    if unknown == "zero":
        out = out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0).cast("bigint")))
    return out


def decode_labels(df: DataFrame, vocab: DataFrame, idx_col: str = "idx", attr_col: str = "attr",
                  out_col: str = "label") -> DataFrame:
    """Index -> label through the same vocabulary (NULL when out of range)."""
    v = vocab.select(F.col("attr").alias(attr_col), F.col("idx").alias(idx_col), F.col("label").alias(out_col))
    return df.join(v, [attr_col, idx_col], "left")
