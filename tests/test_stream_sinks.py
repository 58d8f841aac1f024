from __future__ import annotations

import os

from conftest import SF_SMOKE
from facetspark.plans.catalog import table
from facetspark.plans.queries import _part_labels
from facetspark.session import scratch_path
from facetspark.sources import records as RC
from facetspark.sources import sinks as SK
from facetspark.streaming.file_stream import run_stream


def test_stream_output_equals_batch_output(spark):
    part = table(spark, SF_SMOKE, "part")
    base = scratch_path(spark, "test_stream")
    run_stream(spark, SF_SMOKE, part.schema, _part_labels, f"{base}/out", f"{base}/ckpt", glob="part.parquet",
               timeout_s=300)
    schema = "id bigint, supergroup string, `group` string, module string, brand string"
    streamed = sorted(tuple(r) for r in spark.read.schema(schema).json(f"{base}/out").collect())
    batch = sorted(tuple(r) for r in _part_labels(part).collect())
    assert streamed == batch
    # a restart from the checkpoint finds nothing new and writes nothing twice
    run_stream(spark, SF_SMOKE, part.schema, _part_labels, f"{base}/out", f"{base}/ckpt", glob="part.parquet",
               timeout_s=300)
    assert spark.read.schema(schema).json(f"{base}/out").count() == len(batch)


def test_append_and_ignore_modes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    base = scratch_path(spark, "test_sinks")
    SK.append_jsonl(df, f"{base}/app")
    SK.append_jsonl(df, f"{base}/app")
    assert RC.read_jsonl(spark, f"{base}/app", "id long, v string").count() == 4
    SK.write_if_absent(df, f"{base}/ign")
    SK.write_if_absent(df.limit(1), f"{base}/ign")
    assert spark.read.parquet(f"{base}/ign").count() == 2
    SK.write_partitioned(df.selectExpr("id", "v", "'brand' AS attr"), f"{base}/voc", ["attr"])
    assert SK.read_vocab(spark, f"{base}/voc", "brand").count() == 2
    capped = RC.read_jsonl(spark, f"{base}/app", "id long, v string", nrows=1, order_by="id")
    assert [r.id for r in capped.collect()] == [1]


def test_numbered_lines_follow_file_order(spark):
    from pyspark.sql import functions as F
    base = scratch_path(spark, "test_lines")
    # 3 part files written in key order by a global sort
    spark.range(0, 3000, numPartitions=7).select(F.format_string("line-%05d", "id").alias("value")) \
        .orderBy("value").repartitionByRange(3, "value").sortWithinPartitions("value").write.text(base)
    got = RC.read_numbered_lines(spark, base, "n").collect()
    assert sorted((r.n, r.value) for r in got) == [(i, f"line-{i:05d}") for i in range(3000)]


def test_json_arrays_roundtrip_bounded_files(spark):
    import glob
    import json
    base = scratch_path(spark, "test_arrays")
    df = spark.range(0, 1000).selectExpr("id AS indoml_id", "CAST(id % 3 AS STRING) AS value",
                                         "CASE WHEN id < 500 THEN 'a' ELSE 'b' END AS attr")
    SK.write_json_arrays(df.repartition(2), base, max_bytes=4000, by=["attr"])
    files = [f for f in glob.glob(f"{base}/**/*.txt", recursive=True)]
    sizes = [len(json.load(open(f))) for f in files]
    assert sum(sizes) == 1000 and len(files) >= 9 and max(map(os.path.getsize, files)) < 5000
    back = RC.read_json_array(spark, base, "indoml_id bigint, value string")
    assert sorted((r.indoml_id, r.value, r.attr) for r in back.collect()) == \
        sorted((i, str(i % 3), "a" if i < 500 else "b") for i in range(1000))


def test_hash_shuffle_is_permutation(spark):
    from facetspark.plans.queries import QUERIES
    got = QUERIES["hash_shuffle"](spark, SF_SMOKE).collect()
    docs = table(spark, SF_SMOKE, "documents").count()
    assert sorted(r.pos for r in got) == list(range(docs))
    assert len({r.doc_id for r in got}) == docs
    again = {r.doc_id: r.pos for r in QUERIES["hash_shuffle"](spark, SF_SMOKE).collect()}
    assert again == {r.doc_id: r.pos for r in got}


def test_scratch_lives_under_the_session_checkpoint_dir(spark):
    from facetspark.session import ensure_checkpoint_dir
    conf_dir = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == conf_dir.rstrip("/")
    assert scratch_path(spark, "x").startswith(conf_dir.rstrip("/") + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_numbered_lines_across_file_splits(spark):
    """Files cut into many splits (and splits packed into shared partitions) still number in order."""
    from pyspark.sql import functions as F
    base = scratch_path(spark, "test_split_lines")
    spark.range(0, 4000, numPartitions=3).select(F.format_string("row %06d of a longer line", "id").alias("value")) \
        .orderBy("value").repartitionByRange(2, "value").sortWithinPartitions("value").write.text(base)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert spark.read.text(base).rdd.getNumPartitions() > 10
        got = RC.read_numbered_lines(spark, base, "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.n, r.value) for r in got) == [(i, f"row {i:06d} of a longer line") for i in range(4000)]


def test_checkpoint_dir_fallback_without_setting(tmp_path):
    """A session whose conf names no checkpoint folder still gets one (set on the SparkContext)."""
    import os
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "from facetspark.session import ensure_checkpoint_dir, scratch_path\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "d = ensure_checkpoint_dir(s); assert d == ensure_checkpoint_dir(s)\n"
            "assert scratch_path(s, 'x').startswith(d)\n"
            "assert s.range(5).checkpoint(eager=True).count() == 5\n"
            "print('OK')\n") % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("OK"), out.stderr[-2000:]



def test_json_arrays_split_identical_copies(spark):
    """A third of the rows are identical copies: they are still spread over bounded files."""
    import glob
    import json
    base = scratch_path(spark, "test_array_copies")
    df = spark.range(0, 900).selectExpr("CASE WHEN id < 300 THEN 7 ELSE id END AS indoml_id",
                                        "CASE WHEN id < 300 THEN 'same' ELSE 'v' END AS value")
    SK.write_json_arrays(df, base, max_bytes=3000)
    sizes = [len(json.load(open(f))) for f in glob.glob(f"{base}/**/*.txt", recursive=True)]
    assert sum(sizes) == 900 and max(sizes) <= 150


def test_stream_restart_processes_only_new_files(spark):
    """Several input files, one per micro-batch; a file added later is the only work after a restart."""
    from pyspark.sql import functions as F
    part = table(spark, SF_SMOKE, "part")
    base = scratch_path(spark, "test_stream_restart")
    src = f"{base}/in"
    part.filter(F.col("p_partkey") % 3 == 0).write.parquet(f"{src}/a")
    part.filter(F.col("p_partkey") % 3 == 1).write.parquet(f"{src}/b")
    schema = "id bigint, supergroup string, `group` string, module string, brand string"
    read_src = f"{src}/*"
    run_stream(spark, read_src, part.schema, _part_labels, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1,
               timeout_s=300)
    first = spark.read.schema(schema).json(f"{base}/out").count()
    part.filter(F.col("p_partkey") % 3 == 2).write.parquet(f"{src}/c")
    run_stream(spark, read_src, part.schema, _part_labels, f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1,
               timeout_s=300)
    out = sorted(tuple(r) for r in spark.read.schema(schema).json(f"{base}/out").collect())
    assert first == part.filter(F.col("p_partkey") % 3 != 2).count()
    assert out == sorted(tuple(r) for r in _part_labels(part).collect())
