"""Input layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal ``df`` round-robin into ``partitions`` parts; ``None`` leaves it as the scan made it.

    A small input stored as one Parquet row group is read by one task however
    Spark splits the file. Ask for parts where per-row work is heavy and the
    files are few; leave it out where the scan already has many partitions, as
    it moves every row once.
    """
    return df if partitions is None else df.repartition(partitions)
