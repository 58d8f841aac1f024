"""Array files read by splits, outputs written once, ids appended once, merged sketches, numbered lines."""
from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from facetspark.operators import pairing as PR
from facetspark.operators import vocab as VC
from facetspark.session import scratch_path
from facetspark.sources import records as RC
from facetspark.sources import sinks as SK
from facetspark.sources.arrays import array_record_texts, read_json_array_splits
from facetspark.streaming.file_stream import once_by, run_stream

SCHEMA = "id long, s string, o struct<k:string>, l array<string>"


def _records(n):
    r = random.Random(5)
    text = lambda k: "".join(r.choice('ab"\\{}[],:\né🙂') for _ in range(r.randrange(k)))
    return [{"id": i, "s": text(20), "o": {"k": text(6)} if i % 3 else None, "l": [text(5) for _ in range(r.randrange(3))]} for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_array_splits_read_like_whole_files(spark, tmp_path, small_splits):
    recs = _records(600)
    (tmp_path / "a.json").write_text(json.dumps(recs, indent=4, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n " + json.dumps(recs[:40]) + "\n")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    key = lambda r: json.dumps(r.asDict(True), sort_keys=True)
    got = sorted(map(key, read_json_array_splits(spark, str(tmp_path), SCHEMA).collect()))
    assert got == sorted(map(key, RC.read_json_array(spark, str(tmp_path), SCHEMA).collect())) and len(got) == 640
    texts = array_record_texts(spark, str(tmp_path / "a.json")).orderBy("record").collect()
    assert [json.loads(r.text) for r in texts] == recs and [r.record for r in texts] == list(range(600))


def test_array_cut_short_keeps_its_whole_records(spark, tmp_path, small_splits):
    recs = _records(200)
    text = json.dumps(recs)
    cut = text[: text.rindex('"id"') + 20]
    (tmp_path / "a.json").write_text(cut)
    got = array_record_texts(spark, str(tmp_path)).orderBy("record").collect()
    assert [json.loads(r.text) for r in got[:-1]] == recs[:199]
    with pytest.raises(ValueError):
        json.loads(got[-1].text)
    rows = read_json_array_splits(spark, str(tmp_path), SCHEMA).collect()
    assert len(rows) == 200 and sum(r.id is None for r in rows) <= 1


def test_write_once_redoes_broken_and_skips_whole(spark):
    path = scratch_path(spark, "test_once")
    df = spark.range(100).withColumn("part", F.col("id") % 3)
    with pytest.raises(FileNotFoundError):
        SK.read_once(spark, path)
    # a run whose tasks fail leaves files but no manifest
    broken = df.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("a")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        SK.write_once(broken, path)
    assert SK.read_manifest(spark, path) is None
    assert SK.write_once(df, path, by=["part"]) and SK.read_manifest(spark, path)["rows"] == 100
    before = sorted(map(tuple, SK.read_once(spark, path).collect()))
    assert before == sorted((i, i % 3) for i in range(100))
    # a whole output is not even computed again
    never = df.withColumn("part", F.raise_error(F.lit("computed")).cast("long"))
    assert not SK.write_once(never, path) and sorted(map(tuple, SK.read_once(spark, path).collect())) == before
    empty = scratch_path(spark, "test_once")
    assert SK.write_once(df.limit(0), empty, fmt="json") and not SK.write_once(df, empty)
    assert SK.read_once(spark, empty).columns == ["id", "part"] and SK.read_once(spark, empty).count() == 0


@pytest.mark.parametrize("time", [None, "ts"])
def test_replayed_files_add_no_row(spark, time):
    base = scratch_path(spark, "test_append_once")
    rows = spark.range(200).select("id", (F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"))
    step = lambda d: once_by(d, "id", time, "1 day" if time else None)

    def run():
        run_stream(spark, f"{base}/in", rows.schema, step, f"{base}/out", f"{base}/ckpt", timeout_s=120)
        return sorted(r.id for r in spark.read.schema("id long").json(f"{base}/out").collect())

    rows.where("id < 120").write.parquet(f"{base}/in")
    assert run() == list(range(120))
    rows.where("id >= 60").unionAll(rows.where("id = 150")).write.mode("append").parquet(f"{base}/in")
    assert run() == list(range(200))
    rows.write.mode("append").parquet(f"{base}/in")
    assert run() == list(range(200))
    with pytest.raises(ValueError, match="delay"):
        once_by(rows, "id", "ts")


def test_sketches_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).alias("user"), F.lit("x").alias("one"),
                                    F.lit(None).cast("string").alias("none"))
    s = VC.label_sketches(df, ["user", "one", "none"], by=["day"])
    assert s.count() == 14 and s.agg(F.max(F.length("sketch"))).first()[0] <= 1 << 13
    got = {r.attr: r.n_estimated for r in VC.merged_cardinality(s).collect()}
    assert set(got) == {"user", "one"} and got["one"] == 1 and abs(got["user"] - 20_000) <= VC.sketch_error() * 20_000
    by_day = VC.merged_cardinality(s, ["day", "attr"]).where("attr = 'user'").collect()
    assert len(by_day) == 7 and all(abs(r.n_estimated - 30_000 / 7) < VC.sketch_error() * 4300 for r in by_day)
    both = VC.merged_cardinality(s.where("day < 3").unionByName(s.where("day >= 2")))
    assert {r.attr: r.n_estimated for r in both.collect()} == got


def test_numbered_lines_need_no_range_sort(spark, tmp_path, small_splits):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(900)]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "l.txt").write_text("\n".join(str(i) for i in range(850)))
    f, lab = (RC.read_numbered_lines(spark, str(tmp_path / n), "pos") for n in ("f.txt", "l.txt"))
    assert "rangepartitioning" not in f._jdf.queryExecution().executedPlan().toString()
    got = PR.pair_numbered(f.withColumnRenamed("value", "f"), lab.withColumnRenamed("value", "l")).collect()
    assert sorted((r.pos, r.f, r.l) for r in got) == [(i, lines[i], str(i)) for i in range(850)]
    with pytest.raises(ValueError, match="900 data rows but only 850"):
        PR.pair_numbered(f, lab, strict=True)
