"""Merge per-attribute prediction sets into one record per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(pred: DataFrame, attr: str, seq: int, id_col: str = "id", value_col: str | None = None) -> DataFrame:
    """One attribute's predictions -> ``(id, attr, value, seq)``; ``seq`` orders the sets (later wins)."""
    v = value_col or attr
    return pred.select(F.col(id_col).alias("id"), F.lit(attr).alias("attr"),
                       F.col(v).cast("string").alias("value"), F.lit(seq).cast("bigint").alias("seq"))


def merge_attributes(long: DataFrame, attrs: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, attr, value, seq)`` -> one row per id, one column per attribute.

    The later set (higher ``seq``) wins for an attribute, the larger value
    among equals of one set; an attribute no set
    predicted stays NULL (an absent key once written as JSON). One shuffle on
    the id with map-side partial ``max_by``, instead of N-1 full outer joins.
    The pivot values are fixed, so Spark needn't scan for them.
    """
    return (long.groupBy(id_col).pivot("attr", list(attrs))
            .agg(F.max_by("value", F.struct("seq", "value")))
            .select(id_col, *attrs))
