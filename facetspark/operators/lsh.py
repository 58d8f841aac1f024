"""Approximate nearest neighbours by a banded LSH join.

Every vector gets one signature per table: the sides of ``bits`` random
hyperplanes it lies on. Items are stored under their own signature of each
table; a query looks under its own and under those that differ in the planes it
lies nearest to (``probes`` signatures a table). Signatures with the same first
bits are a group, to which a query is sent once for all those it looks under.
There, items and queries that share a (table, signature) are scored, in blocks of
bounded size that answer with their local top-k, so no pair list is ever made,
and a signature that a third of all rows share is many groups. What several
tables find counts once. While the items are few blocks, blocks of items and of queries
meet instead, and look up all tables there: a row is then sent once per block of the
other side, not per table, and a later table returns only what beats an earlier one.

Dot products are turned into angles by one more coordinate: items of length |x|
get sqrt(M^2 - |x|^2) with M the greatest length, queries get 0; then the
largest dot product is the smallest angle.

Cost: a query is sent to ``tables * probes`` groups at most, an item to ``tables``, or
each to the blocks of the other side where that is less (see :func:`_shift`);
:func:`tune_tables` finds how many tables reach a wanted recall on a bounded
sample of queries, whose exact neighbours it looks up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.operators.retrieval import MOST_ROWS, Sides, _best, block_rows, blocked_topk, topk_neighbours, vector_sides
from facetspark.session import store

_GROUPS = 8  # groups of buckets a core, over all tables
_ROWS = 4096  # vectors whose buckets are found at once


@dataclass(frozen=True)
class Lsh:
    """Random hyperplanes: ``planes[t]`` has one column per bit; the last row belongs to the added coordinate."""

    planes: np.ndarray  # tables x (dimensions + 1) x bits
    length: float  # greatest length of an item
    probes: int

    @property
    def tables(self) -> int:
        return len(self.planes)

    def _sides(self, x: np.ndarray, items: bool) -> np.ndarray:
        """Signed distances from the planes: tables x rows x bits."""
        rest = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(axis=1), 0)) if items else np.zeros(len(x))
        return np.hstack([x, rest[:, None]]) @ self.planes

    def item_buckets(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: the bucket of every item in every table."""
        bits = self.planes.shape[2]
        found = ((self._sides(x, True) > 0) << np.arange(bits)).sum(axis=2)
        return (found + (np.arange(self.tables) << bits)[:, None]).T

    def query_buckets(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x probes: own bucket first, then those across the nearest planes."""
        bits = self.planes.shape[2]
        side = self._sides(x, False)
        own = ((side > 0) << np.arange(bits)).sum(axis=2)
        # a flip costs the squared distances of the planes it crosses
        cost = side * side
        order = np.argsort(cost, axis=2, kind="stable")
        sets = _flips(bits, self.probes)
        of = np.take_along_axis(cost, order, axis=2) @ sets
        nearest = np.argsort(of, axis=2, kind="stable")[:, :, :self.probes]
        flips = np.take_along_axis((1 << order).astype(np.float64) @ sets, nearest, axis=2).astype(np.int64)
        return np.moveaxis((own[:, :, None] ^ flips) + (np.arange(self.tables) << bits)[:, None, None], 0, 1)

    def meetings(self, queries: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Table by table: buckets under which the queries look, the rows of these queries, and the items' buckets.

        Of the first table, whose finds the later ones have to beat, the nearest buckets come first.
        """
        for t in range(self.tables):
            one = replace(self, planes=self.planes[t:t + 1])
            held = np.concatenate([one.item_buckets(items[a:a + _ROWS])[:, 0] for a in range(0, len(items), _ROWS)]).astype(np.uint16)
            asked = np.concatenate([one.query_buckets(queries[a:a + _ROWS])[:, 0] for a in range(0, len(queries), _ROWS)]).astype(np.uint16)
            a = 0
            while a < self.probes:
                b = self.probes if t else min(self.probes, max(1, 2 * a))
                yield asked[:, a:b].ravel(), np.repeat(np.arange(len(asked)), b - a), held
                a = b


@lru_cache
def _flips(bits: int, probes: int) -> np.ndarray:
    """Of the planes by distance, the sets (columns) that can be among the ``probes`` cheapest, small sets of near planes first.

    A set costs no less than one that has at most as many planes from each place on; ``probes`` such sets rule it out.
    """
    sets = np.arange(1 << bits)
    held = (sets[:, None] >> np.arange(bits)) & 1
    held = held[(sets < 1 << min(bits, probes - 1)) & (1 << held.sum(axis=1) <= probes)]
    after = held[:, ::-1].cumsum(axis=1)
    held = held[[(after <= x).all(axis=1).sum() <= probes for x in after]]
    return np.ascontiguousarray(held.T.astype(np.float64))


def fit_lsh(items: DataFrame, bits: int = 8, tables: int = 32, probes: int = 8, vec_col: str = "embedding", seed: int = 1) -> Lsh:
    """Planes for the vectors of ``items``; one aggregate reads their dimension and greatest length.

    ``probes`` is at most 2**``bits``; ``bits`` up to 12 keep a probe list small.
    """
    if not 1 <= bits <= 12 or not 1 <= probes <= 1 << bits:
        raise ValueError(f"bits must be 1 to 12 and probes 1 to 2**bits: {bits}, {probes}")
    square = F.aggregate(F.transform(F.col(vec_col), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    r = items.agg(F.max(F.size(vec_col)).alias("d"), F.max(square).alias("s")).first()
    rng = np.random.default_rng(seed)
    return Lsh(rng.normal(size=(tables, max(1, r["d"] or 1) + 1, bits)), float(np.sqrt(r["s"] or 0.0)), probes)


def _item_buckets(index: Lsh) -> Column:
    @F.pandas_udf("array<long>")
    def find(vec: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(vec), 512):
            out += list(index.item_buckets(np.stack(vec.iloc[a:a + 512].to_numpy()).astype(np.float64)).astype(np.int64))
        return pd.Series(out, dtype=object)

    return F.explode(find("vec"))


def _query_buckets(index: Lsh, shift: int) -> Column:
    """A query's buckets by group, which is the bucket without its ``shift`` low bits: array of (group, its buckets)."""
    @F.arrow_udf("array<struct<_c: long, buckets: array<long>>>")
    def find(vec: pa.Array) -> pa.Array:
        n, x = len(vec), vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(n, -1) if n else np.zeros((0, index.planes.shape[1] - 1))
        found = [np.sort(index.query_buckets(x[a:a + 512]).reshape(len(x[a:a + 512]), -1), axis=1) for a in range(0, max(1, n), 512)]
        found = np.concatenate(found).astype(np.int64)
        row, bucket = np.repeat(np.arange(n), found.shape[1]), found.ravel()
        group = bucket >> shift
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
        lists = pa.ListArray.from_arrays(np.append(start, len(bucket)).astype(np.int32), bucket)
        of = pa.StructArray.from_arrays([pa.array(group[start]), lists], ["_c", "buckets"])
        return pa.ListArray.from_arrays(np.searchsorted(row[start], np.arange(n + 1)).astype(np.int32), of)

    return F.inline(find("vec"))


def _shift(index: Lsh, nodes: int, queries: int) -> int | None:
    """Low bits of a bucket that its group leaves out: a group has a block of items at most, and there are some groups a core.

    None where fewer rows are sent if blocks of queries and of items meet, with all tables looked up there.
    """
    bits, dims = index.planes.shape[2], index.planes.shape[1] - 1
    rows = block_rows(dims)
    if queries * -(-nodes // rows) + nodes * -(-queries // rows) <= index.tables * (queries + nodes):
        return None
    cores = SparkSession.active().sparkContext.defaultParallelism
    groups = max(1.0, nodes / rows, _GROUPS * cores / index.tables)
    return bits - min(bits, int(np.ceil(np.log2(groups))))


def lsh_topk(queries: DataFrame, items: DataFrame, index: Lsh, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
             exclude_self: bool = True, query_rows: int | None = None, item_rows: int | None = None, sides: Sides | None = None) -> DataFrame:
    """The ``k`` largest dot products found per query: ``(qid, rank, nid, score)``; ids, ties and ``sides`` as in ``topk_neighbours``.

    A query that shares no bucket with any item gets no row.
    """
    q, nodes = sides or vector_sides(queries, items, k, id_col, vec_col, exclude_self)
    shift = _shift(index, nodes.count(), q.count())
    if shift is None:
        return _best(blocked_topk(q, nodes, (), k, exclude_self, query_rows, item_rows, index.meetings), k)
    rows = block_rows(index.planes.shape[1] - 1)
    q = q.select("qid", "vec", _query_buckets(index, shift))
    t = nodes.withColumn("bucket", _item_buckets(index)).withColumn("_c", F.shiftright("bucket", shift))
    found = blocked_topk(q, t, ("_c",), k, exclude_self, min(query_rows or MOST_ROWS, rows), min(item_rows or MOST_ROWS, rows))
    return _best(found.groupBy("qid", "nid").agg(F.max("score").alias("score")), k)


def tune_tables(queries: DataFrame, items: DataFrame, index: Lsh, k: int = 5, target: float = 0.95, id_col: str = "id", vec_col: str = "embedding",
                exclude_self: bool = True, sample: int = 200, sides: Sides | None = None) -> Lsh:
    """``index`` with the fewest of its tables that find ``target`` of the exact neighbours of ``sample`` queries (by a hash of the id).

    Raises if all of them find less; the sample's neighbours are the only vectors that reach the driver.
    ``sides`` are those of ``queries`` and ``items``, as in ``topk_neighbours``.
    """
    few = store(queries.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(sample), "sample")
    some = sides and (sides[0].join(few.select(F.col(id_col).cast("bigint").alias("qid")).distinct(), "qid", "left_semi"), sides[1])
    exact = topk_neighbours(few, items, k, id_col, vec_col, exclude_self, sides=some)
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    pairs = exact.join(few.select(F.col(id_col).alias("qid"), vec.alias("q")).dropDuplicates(["qid"]), "qid")
    pairs = pairs.join(items.select(F.col(id_col).alias("nid"), vec.alias("n")), "nid").dropDuplicates(["qid", "nid"]).select("q", "n").toPandas()
    if not len(pairs):
        return replace(index, planes=index.planes[:1])
    asked, held = index.query_buckets(np.stack(pairs["q"].to_numpy())), index.item_buckets(np.stack(pairs["n"].to_numpy()))
    found = np.logical_or.accumulate((asked == held[:, :, None]).any(axis=2), axis=1).mean(axis=0)
    if found[-1] < target:
        raise ValueError(f"{index.tables} tables find {found[-1]:.3f} of the sample's neighbours, wanted {target}: more tables, more probes or fewer bits")
    return replace(index, planes=index.planes[:int(np.argmax(found >= target)) + 1])
