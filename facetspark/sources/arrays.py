"""One large JSON array file read by many tasks.

Spark's ``multiLine`` JSON reader gives a file to one task. Here the file is read
as text cut at every ``}``, which Spark splits like lines, and the records'
boundaries come from a prefix scan over the pieces:

1. the number of quotes before a piece tells whether it starts inside a string;
2. that tells which of its braces count, and their running sum is the depth;
3. a record ends at a piece that brings the depth back to 0, and its text is the
   pieces since the last such end.

Both running sums are taken inside each file split, where pieces are in order, and
raised by the totals of the splits before it, one row per split. No range sort is
needed, and no task holds more than a split and a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetspark.session import store

_FILE, _SPLIT = ["file"], ["file", "start"]


def _running(pieces: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all earlier pieces of the file."""
    inside = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*_SPLIT).agg(F.sum(value).alias("_n"))
    # one row per file split: this window is over the splits of a file
    ahead = Window.partitionBy(*_FILE).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*_SPLIT, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return pieces.join(totals, _SPLIT).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def _braces(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^{]", "")) - F.length(F.regexp_replace(c, r"[^}]", ""))


def array_record_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: the objects of the JSON arrays in ``path``'s files, numbered from 0 within each file.

    Elements that are not objects are not records. A file that ends inside an object
    gives that object's beginning as its last record.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("piece"))
    # escaped characters only occur inside strings: without them every quote opens or closes one
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    runs = F.split(plain, '"')
    even = F.array_join(F.filter(runs, lambda _, i: i % 2 == 0), "")
    odd = F.array_join(F.filter(runs, lambda _, i: i % 2 == 1), "")
    pieces = store(read.select("*", (F.size(runs) - 1).alias("quotes"), _braces(even).alias("outer"), _braces(odd).alias("inner")), "pieces")
    # all pieces but a file's last stand before a closing brace; that one does if the lengths add up so
    ends = pieces.groupBy("file").agg((F.sum(F.octet_length("piece") + 1) == F.max("bytes")).alias("whole"), F.max(F.struct("start", "row")).alias("end"))
    pieces = pieces.join(ends, "file").withColumn("followed", F.col("whole") | (F.struct("start", "row") != F.col("end"))).drop("whole", "end", "bytes")
    pieces = _running(pieces, "quotes", "quotes_before")
    starts_inside = F.col("quotes_before") % 2 == 1
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    # the closing brace behind a piece counts unless it is inside a string
    closing = F.when(ends_inside | ~F.col("followed"), 0).otherwise(1)
    pieces = pieces.withColumn("change", F.when(starts_inside, F.col("inner")).otherwise(F.col("outer")) - closing)
    pieces = store(pieces.select(*_SPLIT, "row", "piece", "followed", "change", (closing == 1).alias("closes")), "depths")
    pieces = _running(pieces, "change", "depth")
    pieces = pieces.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == 0)).cast("int"))
    pieces = _running(store(pieces, "ends"), "ends", "record")
    at = F.struct("start", "row", F.concat("piece", F.when(F.col("followed"), F.lit("}")).otherwise(F.lit(""))).alias("piece"))
    texts = pieces.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda p: p["piece"]), "").alias("text"))
    return texts.where(F.col("text").contains("{")).select("file", "record", F.regexp_replace("text", r"(?s)^[^{]*", "").alias("text"))


def read_json_array_splits(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The records of ``path``'s JSON arrays, as :func:`facetspark.sources.records.read_json_array` reads them, a split per task."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return array_record_texts(spark, path).select(F.from_json("text", st).alias("r")).select("r.*")
