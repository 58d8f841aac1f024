from __future__ import annotations

import pytest

from facetspark.operators.layout import spread
from facetspark.session import SCALE_SETTINGS, apply_scale_settings, ensure_checkpoint_dir, store


def test_spread_is_a_plain_parameter(spark):
    df = spark.range(0, 1000, numPartitions=1)
    assert spread(df, None) is df
    for n in (16, 1):
        out = spread(df, n)
        assert out.rdd.getNumPartitions() == n
        assert sorted(r.id for r in out.collect()) == list(range(1000))


def test_store_prunes_columns(spark):
    df = store(spark.range(10).selectExpr("id", "id * 2 AS b", "'x' AS c"))
    plan = df.select("b").where("b > 4")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in plan and "PushedFilters: [IsNotNull(b), GreaterThan(b,4)]" in plan


def test_scratch_is_dropped_on_request(tmp_path):
    """In a session of its own, as the shared test session's stored tables are still in use."""
    import os
    import subprocess
    import sys
    code = ("import os; from pyspark.sql import SparkSession\n"
            "from facetspark.session import drop_scratch, store\n"
            "s = (SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n"
            "     .config('spark.checkpoint.dir', %r).getOrCreate())\n"
            "assert store(s.range(5)).count() == 5\n"
            "root = os.path.join(%r, 'facetspark-scratch'); assert len(os.listdir(root)) == 1\n"
            "drop_scratch(s); assert os.listdir(root) == []\n"
            "drop_scratch(s); assert store(s.range(3)).count() == 3; print('OK')\n") % (str(tmp_path), str(tmp_path))
    env = dict(os.environ, PYTHONPATH=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("OK"), out.stderr[-2000:]


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_apply_scale_settings_keeps_cluster_values(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "512m")
        apply_scale_settings(spark)
        assert spark.conf.get(key) == "512m"
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == SCALE_SETTINGS[
            "spark.sql.adaptive.skewJoin.enabled"]
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
