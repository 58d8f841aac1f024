"""Session construction, scale settings and the shared scratch location.

Library code never invents a machine-local folder on a cluster: anything that
must be written mid-job (sink round trips, stream checkpoints, stored
intermediates) goes under the folder the cluster names in
``spark.checkpoint.dir``. Only a local master without any checkpoint folder (a
laptop or a test run) gets a local one; elsewhere a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"

# SQL settings the plans rely on at cluster scale. AQE re-plans joins from
# measured sizes (broadcast only under the threshold, shuffle join beyond it),
# splits skewed join partitions and coalesces small shuffle outputs; Arrow
# batches bound the Python side. A cluster's own conf normally carries these;
# ``apply_scale_settings`` fills in only what is unset.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def apply_scale_settings(spark: SparkSession) -> None:
    for k, v in SCALE_SETTINGS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "facetspark", extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_scale_settings(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Order: the ``spark.checkpoint.dir`` setting (what a cluster names), then a
    checkpoint folder the application already gave the SparkContext, and only
    then a local folder (tests, a laptop). ``spark.checkpoint.dir`` is a core
    setting that can't be changed at run time, so the fallback is set on the
    SparkContext only, and later calls find it there.
    """
    sc = spark.sparkContext
    conf = spark.conf.get(_CKPT_KEY, None)
    if conf:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CKPT_KEY} to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="facetspark-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    # The sparkContext checkpoint dir gets a per-app uuid suffix; keep our own
    # files beside it, by application, so they are easy to find and clean up.
    return os.path.join(ensure_checkpoint_dir(spark), "facetspark-scratch", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored. Call it when no DataFrame that was built on it is used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Compute ``df`` once, as Parquet in the shared folder, and read it back.

    Cuts the lineage; whatever reads it later prunes columns and pushes filters
    down. Select the columns that are needed first. A lost executor costs the
    tasks it ran, as for any write; the files stay until the folder is cleaned.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that tasks can import it wherever the job was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="facetspark-package-"), "facetspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()
