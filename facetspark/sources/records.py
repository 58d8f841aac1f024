"""Record sources: lenient key/value lines, strict JSON lines, JSON arrays, CSV, text.

Everything returns a DataFrame; nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facetspark.functions.text import _let, num_text, strip_line, strip_ws

# Fixed values that must equal the reference's for identical parsing:
# the key/value pattern (groups: key, bare number, quoted text) and the record id key.
LENIENT_PATTERN = r'"([^"]+)":\s?(?:(\d+(?:\.\d+)?)|"([^"]+)")'
ID_KEY = "indoml_id"
CORRUPT = "_corrupt"


def lenient_fields(line: Column | str, id_key: str = ID_KEY) -> Column:
    """Parse one ``{"k": v, ...}`` line the lenient way -> ``map<string,string>``.

    Semantics kept from the reference: only bare non-negative numbers and
    non-empty quoted strings are values (``null``, ``""``, negatives, arrays and
    objects are skipped); a quoted value ends at the first ``"`` even when it is
    escaped; numbers render as Python floats (``5`` -> ``5.0``); text values are
    whitespace-trimmed; a repeated key keeps its last value.
    """
    s = strip_line(line)
    keys = F.regexp_extract_all(s, F.lit(LENIENT_PATTERN), 1)
    nums = F.regexp_extract_all(s, F.lit(LENIENT_PATTERN), 2)
    txts = F.regexp_extract_all(s, F.lit(LENIENT_PATTERN), 3)
    entries = F.arrays_zip(keys.alias("k"), nums.alias("n"), txts.alias("t"))

    def value(e: Column) -> Column:
        key = strip_ws(e["k"])
        as_num = F.when(key == id_key, e["n"].try_cast("bigint").cast("string")).otherwise(num_text(e["n"]))
        return F.when(e["n"] != "", as_num).otherwise(strip_ws(e["t"]))

    kv = F.transform(entries, lambda e: F.struct(strip_ws(e["k"]).alias("key"), value(e).alias("value")))

    # Last occurrence of a key wins: keep an entry only if its key doesn't appear
    # later. ``kv`` is bound once so the per-entry work isn't redone per element.
    def last_wins(a: Column) -> Column:
        return F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.greatest(F.size(a), F.lit(1))),
                                                  lambda x: x["key"] == e["key"]))
    return F.map_from_entries(_let(kv, last_wins))


def parse_records(lines: DataFrame, line_col: str = "value", id_key: str = ID_KEY,
                  mode: str = "lenient", schema: StructType | str | None = None,
                  keep_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines -> (good, rejects).

    ``lenient``: map column ``fields`` + ``id`` (bigint); rows whose id is missing
    or not an integer go to ``rejects`` instead of failing the job.
    ``strict``: ``from_json`` with ``schema``; a line that is malformed or has a
    field of another type goes to ``rejects`` with its text in ``_corrupt``, and
    so does one without an integer id if the schema has the id key.
    """
    if mode == "lenient":
        parsed = lines.withColumn("fields", lenient_fields(F.col(line_col), id_key))
        parsed = parsed.withColumn("id", F.col("fields")[id_key].try_cast("bigint"))
    elif mode == "strict":
        if schema is None:
            raise ValueError("strict mode needs a schema")
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        with_corrupt = StructType([*st.fields, StructField(CORRUPT, StringType())])
        rec = F.from_json(F.col(line_col), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        parsed = lines.withColumn("rec", rec).select("*", "rec.*").drop("rec")
        parsed = parsed.withColumn(CORRUPT, F.coalesce(F.col(CORRUPT), F.when(F.col(line_col).isNull() | (F.trim(line_col) == ""), F.lit(""))))
        bad = F.col(CORRUPT).isNotNull()
        if id_key in st.fieldNames():
            parsed = parsed.withColumn("id", F.col(id_key).try_cast("bigint"))
            bad = bad | F.col("id").isNull()
        good, rejects = parsed.filter(~bad).drop(CORRUPT), parsed.filter(bad)
        return (good if keep_line else good.drop(line_col)), rejects
    else:
        raise ValueError(f"unknown mode {mode!r}")
    good = parsed.filter(F.col("id").isNotNull())
    rejects = parsed.filter(F.col("id").isNull())
    if not keep_line:
        good = good.drop(line_col)
    return good, rejects


def project_keys(parsed: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Key-set projection from the parsed map; an absent key is NULL."""
    return parsed.select(F.col(id_col), *[F.col("fields")[k].alias(k) for k in keys])


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Plain line read (one row per line, column ``value``) with the source file name."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))


# order keys of :func:`read_ordered_lines`: part number, file path, split start, row id inside the task
LINE_ORDER = ("_part", "_file", "_start", "_row")


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line read plus the keys that give each line's order in the folder's files.

    Within one file split Spark reads lines in order, so (part number, file path,
    split start, row id inside the task) sorts lines as they stand in the files:
    part files by the number in their name, others by path, then by offset. Pass :data:`LINE_ORDER` as the order of
    :func:`facetspark.operators.pairing.pair_by_position` or :func:`zip_index`.
    """
    return spark.read.text(path).select(
        "value", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint").alias("_part"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"))


BROADCAST_SPLITS = 100_000  # offset rows (a path, two longs) up to which the table is broadcast: some 20 MB


def read_numbered_lines(spark: SparkSession, path: str, line_col: str = "line_no") -> DataFrame:
    """Line read with each line's 0-based position in the folder's files (see :func:`read_ordered_lines`).

    Lines are in order within a file split, so no line is moved: the lines are
    stored once with their split, a table of line counts per split gives each
    split's first number, and a line's place in its split is added to that. The
    running sum is over one row per split.
    """
    from facetspark.session import store

    lines = store(read_ordered_lines(spark, path), "lines")
    splits = lines.groupBy("_part", "_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = store(splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "splits")
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    numbered = lines.join(splits, ["_file", "_start"])
    return numbered.select("value", (F.col("_before") + F.col("_row") - F.col("_first")).alias(line_col))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, nrows: int | None = None,
               order_by: str | None = None) -> DataFrame:
    """Strict JSON-lines read with an explicit schema; optional deterministic row cap."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if nrows is not None:
        df = df.orderBy(order_by or df.columns[0]).limit(nrows)
    return df


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of records, a file per task; for files too large for that see
    :func:`facetspark.sources.arrays.read_json_array_splits`."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def split_from_file_name(file_name: Column | str) -> Column:
    """``attribute_<split>[_x].(data|solution)`` -> ``<split>`` (``<split>_sol`` for solutions)."""
    f = F.col(file_name) if isinstance(file_name, str) else file_name
    base = F.regexp_extract(f, r"^[^_.]*_([^_.]*)", 1)
    return F.when(f.contains("solution"), F.concat(base, F.lit("_sol"))).otherwise(base)


def read_template(spark: SparkSession, path: str) -> str:
    """A prompt template is a few hundred bytes of configuration, read once on the driver."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: a template is one file, found {'none' if not rows else 'several'}")
    return rows[0][0].strip()


def json_fields(line: Column | str, schema: StructType | str) -> Column:
    """Strict JSON text -> struct with an explicit schema; malformed text gives NULL fields."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    c = F.col(line) if isinstance(line, str) else line
    return F.from_json(c, st, {"mode": "PERMISSIVE"})
