"""Sharding by a uniform shuffle with exact shard sizes: a hypergeometric communication matrix.

1. The rows are stored once with the part they were read in (a run of at most
   2**``part_bits`` consecutive rows of one partition) and their place in it.
2. How many rows every part sends to every shard is drawn from the law that a uniform
   shuffle would give: a matrix of fixed row sums (the parts) and column sums (the
   shards, one row apart at most). Groups of parts are drawn first, from their totals;
   then each group's parts, a group a task.
3. Every part is permuted, and its permuted rows are cut at its row of the matrix.
4. The rows are exchanged by shard and slot, where the order of arrival in a shard is
   permuted again to give the slots 0, 1, 2 and so on.

A permutation is a keyed Feistel network on [0, n) that walks on while it is outside,
so neither a part nor a shard is ever held in memory to be permuted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .storage import stored

GROUP_BITS = 42  # parts of 512 partitions (of 2**33 row numbers each) are drawn together
ROUNDS = 8
_STEPS = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64))
BROADCAST_CELLS = 1_000_000  # part x shard cells (16 bytes each) up to which the matrix is broadcast


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of every ``index`` (below its ``size``) under a permutation of [0, ``size``) that ``key`` chooses."""
    x, size = index.astype(np.uint64), size.astype(np.uint64)
    key = mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    half = ((np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64) + np.uint64(2)) >> np.uint64(1))
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + k + _STEPS[r]) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement from ``good + bad`` are good, at any size.

    By inversion over the probabilities within 12 deviations of the mode, each from its
    neighbour's ratio; what lies beyond has a probability under 1e-30.
    """
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * spread) + 30
    a, b = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    at = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(at, rng.random() * at[-1], "right"))


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> np.ndarray:
    """Counts with the given row and column sums (equal totals), by the law of a uniform shuffle."""
    room = [int(c) for c in columns]
    out = np.zeros((len(rows), len(room)), np.int64)
    for i, n in enumerate(rows):
        left, rest = int(n), sum(room)
        for j, c in enumerate(room):
            rest -= c
            out[i, j] = x = hypergeometric(rng, c, rest, left)
            left -= x
            room[j] = c - x
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _permuted(index: Column, size: Column, key: Column) -> Column:
    def image(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts in batches:
            i, n, k = (p.to_numpy(zero_copy_only=False) for p in parts)
            yield pa.array(permuted(i, n, k))

    return F.arrow_udf(image, "long")(index, size, key)


def _matrix(counts: DataFrame, sizes: list[int], seed: int, part_bits: int) -> DataFrame:
    """``part, n, starts, offsets`` of every ``part, n``.

    ``starts``: where a shard's run begins in the permuted part; ``offsets``: how many rows of
    the shard come from earlier parts. Only one total for each group of parts reaches the driver.
    """
    spark, shards = counts.sparkSession, len(sizes)
    counts = counts.withColumn("bunch", F.shiftright("part", GROUP_BITS - part_bits))
    totals = counts.groupBy("bunch").agg(F.sum("n").alias("n")).orderBy("bunch").collect()
    drawn = communication_matrix(np.random.default_rng([seed, 0]), [r.n for r in totals], sizes)
    before = np.cumsum(drawn, axis=0) - drawn
    bunches = spark.createDataFrame([(r.bunch, d.tolist(), b.tolist()) for r, d, b in zip(totals, drawn, before, strict=True)],
                                    "bunch long, room array<long>, before array<long>")

    def draw(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        rng = np.random.default_rng([seed, 1, int(parts["bunch"].iloc[0])])
        cells = communication_matrix(rng, parts["n"].tolist(), list(parts["room"].iloc[0]))
        starts = np.cumsum(cells, axis=1) - cells
        offsets = np.asarray(parts["before"].iloc[0], np.int64) + np.cumsum(cells, axis=0) - cells
        return pd.DataFrame({"part": parts["part"], "n": parts["n"], "starts": list(starts), "offsets": list(offsets)})

    out = counts.join(bunches, "bunch").groupBy("bunch").applyInPandas(draw, "part long, n long, starts array<long>, offsets array<long>")
    out = stored(out, "matrix")
    return F.broadcast(out) if out.count() * shards <= BROADCAST_CELLS else out


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 13, cell_rows: int = 1 << 16, part_bits: int = 20) -> DataFrame:
    """Every input row once, uniformly shuffled: ``row`` (a struct of all its columns), ``shard``, ``slot``.

    Shards 0 to ``shards - 1`` have row counts at most one apart; slots count from 0 without a
    gap in every shard. Rows are placed whatever they hold: nulls, empty and very long texts,
    copies and exactly repeated rows are rows like others, and no column name can clash with
    the two new ones. Shards are empty where there are fewer rows than shards. The result is
    laid out by shard and slot, ``cell_rows`` slots a partition, sorted. The same input
    layout gives the same result for one ``seed``; lost tasks read the stored rows again.
    """
    number = F.monotonically_increasing_id()
    rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), number.alias("number")), "rows")
    part = F.shiftright("number", part_bits)
    counts = stored(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = shard_sizes(total, shards)
    matrix = _matrix(counts, sizes, seed, part_bits)
    dealt = rows.withColumn("part", part).join(matrix, "part")
    at = _permuted(F.col("number").bitwiseAND(F.lit((1 << part_bits) - 1)), F.col("n"), F.xxhash64("part", F.lit(seed)))
    dealt = dealt.withColumn("at", at)
    # starts ascend, and an empty run starts where the next one does: the last start not after ``at`` is the shard's
    dealt = dealt.withColumn("shard", F.size(F.filter("starts", lambda s: s <= F.col("at"))) - 1)
    arrival = F.get("offsets", F.col("shard")) + F.col("at") - F.get("starts", F.col("shard"))
    size = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    dealt = dealt.select("row", "shard", _permuted(arrival, size, F.xxhash64("shard", F.lit(seed), F.lit(2))).alias("slot"))
    cells = max(1, -(-max(sizes) // cell_rows))  # a shard's partitions
    cell = F.col("shard") * cells + F.floor(F.col("slot") / cell_rows).cast("int")
    return dealt.repartitionById(shards * cells, cell).sortWithinPartitions("shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=s`` for each shard, its files in slot order and each sorted by ``slot``; the columns are the rows'.

    A column of the rows that is called ``shard`` or ``slot`` goes into the file as ``row_shard`` or ``row_slot``.
    """
    names = sharded.schema["row"].dataType.names
    columns = [F.col("row")[c].alias(f"row_{c}" if c in ("shard", "slot") else c) for c in names]
    sharded.select(*columns, "slot", "shard").write.partitionBy("shard").parquet(path)
