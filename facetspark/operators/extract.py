"""Attribute extraction from generated text and parsing of model replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facetspark.functions.text import MISSING_LABEL, extract_fields


def extract_attributes(df: DataFrame, text_col: str, attrs: Sequence[str], id_col: str = "id",
                       missing: str = MISSING_LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, *keep, attr_1..attr_n)`` with a fixed key order; a non-matching text gives ``missing`` for all."""
    return df.select(F.col(id_col), *keep, *extract_fields(F.col(text_col), attrs, missing))


def clean_reply(text: Column | str) -> Column:
    """Reply body -> JSON object text.

    Take the second segment between literal ``\\n`` markers, keep the first
    ``{...}`` (up to the first ``}``) provided no ``}`` comes before the ``{``,
    then drop real newlines and backslashes. NULL when the marker is missing
    (where the reference stops the whole run), ``''`` when no object is found.
    """
    t = F.col(text) if isinstance(text, str) else text
    seg = F.try_element_at(F.split(t, r"\\n"), F.lit(2))
    obj = F.regexp_extract(seg, r"^[^{}]*(\{[^}]*\})", 1)
    return F.regexp_replace(obj, r"[\n\\]", "")


def parse_reply(df: DataFrame, text_col: str, schema: StructType | str, id_col: str = "id",
                keep_clean: bool = True, keep_corrupt: bool = False) -> DataFrame:
    """Replies -> typed columns + ``cleaned``; unparsable replies give NULL fields, not a failure.

    With ``keep_corrupt`` the column ``_corrupt`` holds the reply's text where no
    JSON object of the schema could be read from it, so that a failed parse and
    an absent field differ.
    """
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    marked = StructType([*st.fields, StructField("_corrupt", StringType())])
    out = df.select(F.col(id_col), F.col(text_col).alias("_text"), clean_reply(F.col(text_col)).alias("cleaned"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    out = out.withColumn("_r", F.from_json(F.nullif(F.col("cleaned"), F.lit("")), marked, options))
    failed = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    cols = [F.col(id_col)] + ([F.col("cleaned")] if keep_clean else []) + \
        [F.col("_r")[f.name].alias(f.name) for f in st.fields] + \
        ([F.when(failed, F.col("_text")).alias("_corrupt")] if keep_corrupt else [])
    return out.select(*cols)
