"""Distributed positional index (what ``zipWithIndex`` gives an RDD), DataFrame only.

``row_number() over (order by k)`` without a partition moves every row into
one task. Instead: range-partition on the order key into a fixed number of
partitions, sort inside each, take the in-partition position from
``monotonically_increasing_id`` (partition id in the upper bits, position in
the lower 33), then add each partition's start offset. The offset table has
one row per partition, so broadcasting it has a proven size bound.

The ranged, sorted rows are written once, each with its partition number and its
position there; rows and per-partition counts are both read from that one
stored table. So positions never depend on a plan being evaluated the same way
twice (range bounds come from a sample that depends on the plan). Ties in the
order key are broken by a hash of the row's content, so only identical copies
(which are interchangeable) can trade positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.session import store

_LOW_BITS = (1 << 33) - 1


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that hold maps are hashed as JSON text."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.to_json(F.struct(c.alias("c"))) if "map<" in kind else c

    return F.xxhash64(*(one(c, t) for c, t in df.dtypes))


def zip_index(df: DataFrame, order: Sequence[str | Column], index_col: str = "pos",
              num_partitions: int | None = None, start: int = 0) -> DataFrame:
    """Add a dense 0-based (or ``start``-based) position in ``order`` order.

    The input is computed once and stored with its positions (see above), so
    select the columns that are needed first.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, content_hash(df).alias("_tie")]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = store(ranged.withColumn("_pid", F.spark_partition_id())
                   .withColumn("_local", mid.bitwiseAND(F.lit(_LOW_BITS))), "positions")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here is over <= n rows, and so is the broadcast
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(index_col, F.col("_off") + F.col("_local") + F.lit(start)).drop("_pid", "_local", "_off")


def dense_index(df: DataFrame, group: str, value: str, index_col: str = "idx",
                start: int = 0, num_partitions: int | None = None, broadcast_groups: int = 50_000) -> DataFrame:
    """Dense rank of the distinct ``value`` inside each ``group`` (0-based by default).

    Same as ``dense_rank() over (partition by group order by value) - 1`` but a
    group with millions of distinct values is spread over many tasks: the
    global position comes from :func:`zip_index` and each group's first
    position is subtracted. The table of first positions has one row per group;
    it is broadcast up to ``broadcast_groups`` rows (a few MB), else joined by
    shuffle. The result is stored once, so every later lookup reads the same
    small table instead of re-deriving it.
    """
    distinct = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    pos = zip_index(distinct, [group, value], "_g", num_partitions)
    starts = store(pos.groupBy(group).agg(F.min("_g").alias("_g0")), "starts")
    starts = F.broadcast(starts) if starts.limit(broadcast_groups + 1).count() <= broadcast_groups else starts
    out = (pos.join(starts, pos[group].eqNullSafe(starts[group])).drop(starts[group])
           .withColumn(index_col, (F.col("_g") - F.col("_g0") + F.lit(start)).cast("bigint"))
           .drop("_g", "_g0"))
    return store(out, "index")
