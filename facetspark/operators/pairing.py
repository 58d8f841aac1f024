"""Pairing data records with their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import NULL_TEXT, num_text, render_fields
from facetspark.operators.indexing import zip_index


def pair_by_id(data: DataFrame, labels: DataFrame, key: str = "id", how: str = "inner", fields: str | None = None) -> DataFrame:
    """Equi-join data and solution rows on the record id (shuffle join on ``key``).

    ``fields`` names the data side's map of parsed keys, see :func:`prefer_data`.
    """
    overlap = [c for c in labels.columns if c in data.columns and c != key]
    return prefer_data(data.join(labels.select(key, *[F.col(c).alias(f"_lbl_{c}") for c in labels.columns
                                                      if c != key]), key, how), overlap, fields)


def prefer_data(joined: DataFrame, columns: Sequence[str], fields: str | None = None) -> DataFrame:
    """For a field on both sides the data side wins if its record has the key, even with a null value;
    the label side fills in when the key is absent.

    ``fields`` is the map column that tells which keys a record has; a flat row
    cannot tell an absent key from a null, so without it null counts as absent.
    """
    out = joined
    for c in columns:
        there = F.col(c).isNotNull() if fields is None else F.coalesce(F.map_contains_key(fields, F.lit(c)), F.lit(False))
        out = out.withColumn(c, F.when(there, F.col(c)).otherwise(F.col(f"_lbl_{c}"))).drop(f"_lbl_{c}")
    renames = [c for c in out.columns if c.startswith("_lbl_")]
    for c in renames:
        out = out.withColumnRenamed(c, c[len("_lbl_"):])
    return out


def pair_by_position(data: DataFrame, labels: DataFrame, data_order: Sequence[str],
                     label_order: Sequence[str], strict: bool = False, pos_col: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Pair the i-th data row with the i-th label row (positions in the given orders).

    The reference zips two files by line; file order isn't a contract in a
    distributed read, so both sides need an explicit order key. ``strict=False``
    keeps ``min(len)`` pairs like ``zip``; ``strict=True`` raises when a data
    row has no label row (counted on the stored positions, not on the inputs).
    """
    return pair_numbered(zip_index(data, data_order, pos_col, num_partitions),
                         zip_index(labels, label_order, pos_col, num_partitions), strict, pos_col)


def pair_numbered(d: DataFrame, lab: DataFrame, strict: bool = False, pos_col: str = "pos") -> DataFrame:
    """:func:`pair_by_position` of rows that have their positions, such as ``records.read_numbered_lines`` gives."""
    if strict:
        nd, nl = d.count(), lab.count()
        if nl < nd:
            raise ValueError(f"positional pairing: {nd} data rows but only {nl} label rows")
    overlap = [c for c in lab.columns if c in d.columns and c != pos_col]
    lab = lab.select(pos_col, *[F.col(c).alias(f"_lbl_{c}") if c in overlap else F.col(c)
                                for c in lab.columns if c != pos_col])
    return prefer_data(d.join(lab, pos_col, "inner"), overlap)


def field_text(df: DataFrame, name: str):
    """A column as it prints in rendered text: numbers in Python float form, the rest as strings."""
    from pyspark.sql.types import NumericType
    c = F.col(name)
    return num_text(c) if isinstance(df.schema[name].dataType, NumericType) else c.cast("string")


def seq2seq_pairs(data: DataFrame, solution: DataFrame, inputs: Sequence[str], labels: Sequence[str],
                  key: str = "id", null_text: str | None = NULL_TEXT) -> DataFrame:
    """Data x solution on ``key`` -> ``(key, input_text, target_text)``.

    Both texts are ``name: value`` pairs in the given column order; a missing
    value prints as ``null_text`` (``None`` drops the pair).
    """
    j = pair_by_id(data.select(key, *inputs), solution.select(key, *labels), key)
    return j.select(key,
                    render_fields([(c, field_text(j, c)) for c in inputs], null_text).alias("input_text"),
                    render_fields([(c, field_text(j, c)) for c in labels], null_text).alias("target_text"))
