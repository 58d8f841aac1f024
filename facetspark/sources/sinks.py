"""Sinks. Every writer is a distributed ``DataFrameWriter`` call.

The reference dumps JSON arrays with indentation; a single array needs one
writer task, so we write JSON lines (one file per partition) instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_jsonl(df: DataFrame, path: str, mode: str = "error", keep_nulls: bool = False) -> None:
    """JSON lines; a NULL field is an absent key unless ``keep_nulls``."""
    (df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower())
     .json(path))


def write_json_arrays(df: DataFrame, path: str, max_bytes: int = 64 << 20, by: Sequence[str] = (),
                      pretty: bool = True, mode: str = "error") -> None:
    """Files that each hold ONE JSON array of records (the reference's ``json.dump`` of a list).

    A single array for the whole table would need one writer task. Instead each
    task strings its own records together, per ``by`` folder, and starts a new
    array (file) at ``max_bytes``: one pass without a shuffle, and no group ever
    holds more than ``max_bytes`` and a record, whatever the keys. Every folder
    of ``by`` is buffered by itself, so ``by`` must have few values. Read back
    with :func:`facetspark.sources.records.read_json_array`.
    """
    cols = [c for c in df.columns if c not in by]
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    rows = df.select(*by, F.to_json(F.struct(*cols), options).alias("value"))
    schema = StructType([*(rows.schema[c] for c in by), StructField("bucket", StringType()), StructField("value", StringType())])

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list[str], int]] = {}
        part, done = TaskContext.get().partitionId(), 0

        def flush(key: tuple) -> pd.DataFrame:
            nonlocal done
            done += 1
            text = "[" + ",\n".join(held.pop(key)[0]) + "]"
            return pd.DataFrame([(*key, f"{part}-{done}", text)], columns=schema.fieldNames())

        for batch in batches:
            for *key, text in batch.itertuples(index=False, name=None):
                key = tuple(key)
                texts, size = held.get(key, ([], 0))
                texts.append(text)
                held[key] = (texts, size + len(text))
                if size + len(text) >= max_bytes:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    rows.mapInPandas(arrays, schema).write.mode(mode).partitionBy(*by, "bucket").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append finished records (the reference appends one record at a time)."""
    write_jsonl(df, path, mode="append")


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Skip when the output folder exists, whatever is in it; see :func:`write_once` for whole outputs only."""
    df.write.mode("ignore").format(fmt).save(path)


_MANIFEST = "_manifest.json"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a complete output, or None if ``path`` holds none (nothing, or what a failed run left)."""
    fs, hadoop_path = _file_system(spark, path)
    at = hadoop_path(f"{path}/{_MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_once(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> bool:
    """Write ``df`` unless ``path`` holds a complete output; whether it was written.

    Every attempt writes a folder of its own below ``path``. Only when it is whole does a small
    manifest appear, under its name in one step, that tells the folder, its rows and its format;
    :func:`read_once` reads what it names. So a folder without a manifest, as a failed run leaves
    it, is written again and never read, and of a repeated call nothing is computed. Two
    writers at a time both write; the manifest names one of their folders, each whole.
    """
    spark = df.sparkSession
    if read_manifest(spark, path) is not None:
        return False
    attempt = f"attempt-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).partitionBy(*by).save(f"{path}/{attempt}")
    # counted in what was written (from the footers, if Parquet)
    rows = spark.read.schema(df.schema).format(fmt).load(f"{path}/{attempt}").count()
    text = json.dumps({"folder": attempt, "format": fmt, "rows": rows, "schema": df.schema.jsonValue()})
    fs, hadoop_path = _file_system(spark, path)
    draft = hadoop_path(f"{path}/_draft-{attempt}.json")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, hadoop_path(f"{path}/{_MANIFEST}")) and read_manifest(spark, path) is None:
        raise OSError(f"{path}: the manifest could not be put in place")
    return True


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_once` wrote; an output without a manifest raises."""
    m = read_manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"{path}: no complete output")
    return spark.read.schema(StructType.fromJson(m["schema"])).format(m["format"]).load(f"{path}/{m['folder']}")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet partitioned on disk (e.g. by ``split`` or ``attr``) so reads prune."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_vocab(spark: SparkSession, path: str, attr: str | None = None) -> DataFrame:
    """Vocabulary table (attr, label, idx); the attr filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(df["attr"] == attr) if attr is not None else df


def read_neighbours(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Neighbour lists ``(id, neighbour_ids array<bigint>)``."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)
