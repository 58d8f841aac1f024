"""Hard-negative mining with bounds from segment summaries.

Every vector is cut into segments; each keeps its mean and its deviation (the length of
what is left without the mean). Two segments' inner product lies within
``length * mean * mean' +- deviation * deviation'``, so sums over the segments bound a
score without the vectors. The finest summaries are stored with the vectors; a coarser
level follows from them. In a block of anchors and rows, the bounds of each level drop
the pairs that cannot be among the best, finer levels judge what is left, and only pairs
that no level drops are scored exactly.

Two searches run over such blocks: every anchor's positives among the rows of its label,
then the best negatives within the score range that each positive sets. Block counts
follow the row counts, so a task holds ``anchor_rows`` anchors and ``item_rows`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .whitening import usable

LEVELS = (1, 4, 16)  # segments of a vector, coarse to fine; each number divides the next
CELLS = 1 << 19  # pairs judged at once in a task
EXACT = 1 << 52  # scores stay below this, where doubles hold every integer
FAR = float(1 << 53)


def edges(d: int, segments: int) -> np.ndarray:
    """The ``segments + 1`` cuts of ``d`` dimensions; those of a divisor of ``segments`` are among them."""
    return np.arange(segments + 1) * d // segments


def levels_of(d: int) -> list[int]:
    return [s for s in LEVELS if s <= d]


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of every row."""
    at = edges(x.shape[1], segments)
    long = np.diff(at)
    mean = np.add.reduceat(x, at[:-1], axis=1) / long
    rest = x - np.repeat(mean, long, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))


def coarser(mean: np.ndarray, deviation: np.ndarray, d: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of ``segments`` segments from the finest ones."""
    fine = mean.shape[1]
    long = np.diff(edges(d, fine)).astype(float)
    first = np.arange(segments) * (fine // segments)
    whole = np.add.reduceat(long, first)
    m = np.add.reduceat(mean * long, first, axis=1) / whole
    apart = mean - np.repeat(m, fine // segments, axis=1)
    return whole, m, np.sqrt(np.add.reduceat(deviation * deviation + long * apart * apart, first, axis=1))


def _numbers(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; -inf where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


class _Side:
    """One side of a block: ids, label codes, vectors, and summaries by level."""

    def __init__(self, t: pa.Table):
        self.ids = t["id"].to_numpy()
        self.x = _numbers(t["x"])
        self.d = self.x.shape[1]
        mean, deviation = _numbers(t["means"]), _numbers(t["deviations"])
        self.levels = []
        for s in levels_of(self.d):
            long, m, dev = coarser(mean, deviation, self.d, s)
            self.levels.append((m * np.sqrt(long), dev))


def best_in_range(asked: _Side, held: _Side, who: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
                  allowed: Callable[[np.ndarray], np.ndarray], counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every range i, the ``k`` best of ``held`` (ids ascending) for anchor ``who[i]`` with a score in [low, high].

    Returns range, row and score. ``allowed(anchors)`` says which rows an anchor may take.
    ``counts`` gathers how many pairs there were and how many were scored.
    """
    out = []
    step = max(1, CELLS // max(1, len(held.ids)))
    for a in range(0, len(who), step):
        anchors, back = np.unique(who[a:a + step], return_inverse=True)
        least, most = low[a:a + step, None].astype(float), high[a:a + step, None].astype(float)
        alive = allowed(anchors)[back]
        for level, (m, dev) in enumerate(asked.levels):
            other_m, other_dev = held.levels[level]
            middle, reach = m[anchors] @ other_m.T, dev[anchors] @ other_dev.T
            reach += 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding
            upper, lower = (middle + reach)[back], (middle - reach)[back]
            alive &= (upper >= least) & (lower <= most)
            # rows surely in range: nothing below the k-th best of them can be among the best
            sure = np.where(alive & (lower >= least) & (upper <= most), lower, -np.inf)
            least = np.maximum(least, _kth(sure, k)[:, None])
            alive &= upper >= least
            if not alive.any():
                break
        rows = np.flatnonzero(alive.any(axis=1))
        columns = np.flatnonzero(alive.any(axis=0))
        if counts is not None:
            counts["pairs"] = counts.get("pairs", 0) + alive.size
            counts["scored"] = counts.get("scored", 0) + int(alive.sum())
        if not len(rows):
            continue
        score = (asked.x[anchors] @ held.x[columns].T)[back[rows]]
        score[~alive[np.ix_(rows, columns)] | (score < low[a:a + step][rows, None]) | (score > high[a:a + step][rows, None])] = -np.inf
        kth = _kth(score, k)
        i, j = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
        value = score[i, j]
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a + rows[i[keep]], columns[j[keep]], value[keep].astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


_POSITIVE = "anchor_id long, anchor_tag long, positive_id long, positive_tag long, positive_score long"
_NEGATIVE = "anchor_id long, anchor_tag long, positive_id long, positive_tag long, positive_score long, negative_id long, negative_score long"


def _first(rows: DataFrame, by: tuple[str, ...], score: str, other: str, k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), *(F.col(c) for c in (f"{other}_id", f"{other}_tag") if c in rows.columns))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def mining_rows(table: DataFrame, anchors: Column, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """``id, tag, label, asks, size, x, means, deviations`` of the usable rows, once each, stored; ``x`` holds integers."""
    kind = table.select(label.alias("l")).schema[0].dataType.simpleString()
    v = F.col(vector_col)
    rows = table.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(v)).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"),
        F.transform(v, lambda c: c.cast("double") * scale).alias("v")).distinct()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, means, deviations = [], [], []
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
            for a, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
                limit = isqrt(EXACT // int(size))
                one = np.clip(flat[a:a + size], -limit, limit)
                mean, deviation = summaries(one[None, :], levels_of(int(size))[-1])
                x.append(one.astype(np.int64))
                means.append(mean[0])
                deviations.append(deviation[0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(x, pa.list_(pa.int64())), pa.array(means, pa.list_(pa.float64())), pa.array(deviations, pa.list_(pa.float64()))],
                names=["id", "label", "asks", "x", "means", "deviations"])

    rows = rows.mapInArrow(summarise, f"id long, label {kind}, asks boolean, x array<long>, means array<double>, deviations array<double>")
    return stored(rows.withColumn("tag", F.xxhash64("label", "x")).withColumn("size", F.size("x")), "summaries")


def mine_hard_negatives(table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                        id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", scale: int = 256,
                        anchor_rows: int = 2048, item_rows: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every row that meets ``anchors``.

    A component c counts as floor(``scale`` * c), a score is the integer inner product; higher
    scores come first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of its label. For each, the first ``negatives`` rows of another label with
    ``low`` * positive <= 100 * score <= ``high`` * positive are returned, ranked from 1; a
    positive without any gives no row (as a negative positive score allows none).

    Rows without an id or label, or whose vector is null or empty or holds null or non-finite
    components, take no part. A row is never compared with a row of its own id, nor with a vector
    of another length. Repeated rows (same id, label and vector) count once; different rows of one id
    are rows apart. Components are held within +-isqrt(2**52 / dimensions), so that scores are
    exact. Extra columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = mining_rows(table, anchors, id_col, label, vector_col, scale)
    one = ("id", "tag", "x", "means", "deviations")
    blocks = lambda n, of: F.ceil(F.col(n) / of).cast("long")
    block = lambda n: F.pmod(F.xxhash64("id", "tag", F.lit(3)), F.col(n))

    # positives: a label's anchors against its rows, in blocks of both
    counts = rows.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_asks")).where("n_asks > 0")
    counts = stored(counts.select("size", "label", blocks("n", item_rows).alias("items"), blocks("n_asks", anchor_rows).alias("askers")), "labels")
    own = rows.join(counts, ["size", "label"])
    key = ("size", "label", "item_block", "asker_block")
    asked = own.where("asks").withColumn("asker_block", block("askers")).withColumn("item_block", _each(F.col("items"))).select(*key, *one)
    held = own.withColumn("item_block", block("items")).withColumn("asker_block", _each(F.col("askers"))).select(*(F.col(c).alias(c) for c in (*key, *one)))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = not len(a) or not len(b)
        if empty:
            return _table(_POSITIVE, [[]] * 5)
        b = b.sort_by([("id", "ascending"), ("tag", "ascending")])
        q, r = _Side(a), _Side(b)
        n = np.arange(len(q.ids))
        i, j, score = best_in_range(q, r, n, np.full(len(n), -FAR), np.full(len(n), FAR), positives, lambda who: q.ids[who][:, None] != r.ids[None, :])
        return _table(_POSITIVE, [q.ids[i], a["tag"].to_numpy()[i], r.ids[j], b["tag"].to_numpy()[j], score])

    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(nearest, _POSITIVE)
    best = stored(_first(found, ("anchor_id", "anchor_tag"), "positive_score", "positive", positives).drop("rank").where("positive_score >= 0"), "positives")

    # negatives: anchors with the ranges of their positives against all rows, in blocks of both
    goals = best.groupBy("anchor_id", "anchor_tag").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_tag", "positive_score"))).alias("goals"))
    asking = rows.where("asks").join(goals, (F.col("id") == F.col("anchor_id")) & (F.col("tag") == F.col("anchor_tag")))
    asking = stored(asking.select("size", "label", *one, "goals"), "ranges")
    grid = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).join(asking.groupBy("size").agg(F.count(F.lit(1)).alias("n_asks")), "size")
    grid = stored(grid.select("size", blocks("n", item_rows).alias("items"), blocks("n_asks", anchor_rows).alias("askers")), "lengths")
    key = ("size", "item_block", "asker_block")
    asked = asking.join(grid, "size").withColumn("asker_block", block("askers")).withColumn("item_block", _each(F.col("items"))).select(*key, "label", *one, "goals")
    held = rows.join(grid, "size").withColumn("item_block", block("items")).withColumn("asker_block", _each(F.col("askers"))).select(*(F.col(c).alias(c) for c in (*key, "label", *one)))

    def within(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _table(_NEGATIVE, [[]] * 7)
        b = b.sort_by([("id", "ascending"), ("tag", "ascending")])
        q, r = _Side(a), _Side(b)
        codes = pa.chunked_array([*a["label"].chunks, *b["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = codes[:len(a)], codes[len(a):]
        goals = a["goals"].combine_chunks()
        who = np.repeat(np.arange(len(a)), goals.value_lengths().to_numpy())
        goal = goals.flatten()
        score = goal.field("positive_score").to_numpy()
        least, most = -((-low * score) // 100), (high * score) // 100
        i, j, value = best_in_range(q, r, who, least, most, negatives, lambda w: (mine[w][:, None] != theirs[None, :]) & (q.ids[w][:, None] != r.ids[None, :]))
        return _table(_NEGATIVE, [q.ids[who[i]], a["tag"].to_numpy()[who[i]], goal.field("positive_id").to_numpy()[i],
                                  goal.field("positive_tag").to_numpy()[i], score[i], r.ids[j], value])

    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(within, _NEGATIVE)
    out = _first(found, ("anchor_id", "anchor_tag", "positive_id", "positive_tag"), "negative_score", "negative", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(schema: str, columns: list) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def brute_force(rows: list[tuple], anchors: Callable[[int], bool], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> list[tuple]:
    """The definition in plain Python over (id, label, integer vector) rows with ids of their own."""
    out = []
    for i, label, x in rows:
        if not anchors(i):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for j, other, y in rows if j != i))
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, s) for s, n, other in scored if other != label and low * -minus <= 100 * -s <= high * -minus][:negatives]
            out += [(i, j, rank, n, -minus, -s) for rank, (n, s) in enumerate(fit, 1)]
    return out
