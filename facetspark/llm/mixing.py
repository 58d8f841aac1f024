"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Every source has a weight and a schedule: its rate of use over training time t in
[0, 1] is weight * (1 + slope * (2 t - 1)). Integrated, that gives the source's
cumulative demand; its documents, in a hashed order and repeated as often as the
demand needs, are laid along it, and inverting the demand gives each document its
training position, by which the result is range-sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.operators.indexing import content_hash

from .hashing import WORD
from .storage import stored

# Weights by source in code point order, repeating; a slope for each.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
BUCKET_DIGITS = 3  # leading hex digits of a document's order hash: 4,096 parts of any source


def _cycle(values: tuple[float, ...], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_size, nth, target`` from ``source, size`` rows.

    The total is shared by weight; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight until none is above. That is
    min(most * size, level * weight) with one level, found by sorting sources by the
    level at which they fill up. These windows are over the sources, not the documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", _cycle(weights, F.col("nth")))
    w = w.withColumn("cap", F.lit(most) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(whole) - before) / open_weight)
    level = F.max("level").over(whole)
    return w.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "nth", "target")


def demand_time(share: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand, t + slope * (t * t - t) of its target, reaches ``share``."""
    rest = F.lit(1.0) - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(rest * rest + 4 * slope * share) - rest) / (2 * slope))


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = 3,
                   carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row, ordered by training position: ``id_col``, ``size``, ``source_size``, ``target``,
    ``taken``, ``position``, ``positions``, ``key``, and the columns that ``carry`` names as the struct ``carried``.

    ``size`` counts words (null text: 0). A source's documents follow each other in
    the order of a hash of their id; the demand runs over them again and again, at
    most ``most`` times, and stops at the target, inside a document if need be:
    ``taken`` adds up a document's words over the passes, so a source's sum is its
    target rounded. ``positions`` are the times of the passes whose middle is
    reached, ``position`` the first (null: the document is not used). A null source is
    a source of its own, last. Empty documents take nothing. Repeated rows are
    separate documents; ties in the order go by size and text hash. Documents
    without an id are ordered by a hash of their text and place in the input, so they
    are spread like others; rows of one id follow each other, in one running sum that
    holds no rows in memory. ``key`` is a hash of id and text. Extra columns are not read.
    """
    out = _placed(docs, id_col, text_col, source_col, weights, slopes, most, carry)
    return out.orderBy(F.col("position").asc_nulls_last(), F.col(id_col), "key")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES,
            most: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`curriculum_mix` in no order."""
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    place = F.concat_ws(":", F.xxhash64(F.col(text_col)), F.monotonically_increasing_id())
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), place)).alias("hash"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), *carried)
    rows = stored(rows, "sizes").withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    targets = source_targets(rows, weights, most).withColumnRenamed("source", "t")
    offsets = offsets.join(targets, F.col("s").eqNullSafe(F.col("t"))).select("s", "b", "before", "source_size", "nth", "target")
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    end = F.floor(F.col("target") + 0.5)
    start = [F.col("source_size") * p + F.col("at") for p in range(most)]
    taken = sum((F.least(F.greatest(end - s, F.lit(0)), F.col("size")) for s in start), F.lit(0))
    slope = _cycle(slopes, F.col("nth"))
    middle = [s + F.col("size") / 2 for s in start]
    times = F.array_compact(F.array(*(F.when((F.col("size") > 0) & (m < end), demand_time(F.least(m / F.col("target"), F.lit(1.0)), slope)) for m in middle)))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
                         F.get(times, F.lit(0)).alias("position"), times.alias("positions"), "key", *(["carried"] if carry else []))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """The mixed documents, one row for each of their positions, range-sorted by position; columns of ``docs``.

    Every row has its own positions and keeps its own columns, whatever its id: rows without
    an id, or that share one, are documents like others. Rows that are equal in all columns are
    held once and stand at the positions of all of them (told apart by 128 bits of hash over
    all columns). Empty documents take no position, so they are not in it.
    """
    whole = content_hash(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(source_col).alias("source"), whole.alias("k1"), F.xxhash64(F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))).alias("k2"))
    places = _placed(rows.select("id", "text", "source", "k1", "k2"), "id", "text", "source", carry=("k1", "k2"), **mix)
    places = stored(places.select("carried.k1", "carried.k2", F.explode("positions").alias("position")), "positions")
    out = rows.select("row", "k1", "k2").dropDuplicates(["k1", "k2"]).join(places.hint("shuffle_merge"), ["k1", "k2"])
    return out.orderBy("position", "k1", "k2").select(*(F.col("row")[c].alias(c) for c in docs.columns))
