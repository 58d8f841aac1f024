"""Nearest-neighbour retrieval over stored vectors and neighbour-list handling.

Exact top-k is a blocked matrix product. Equal item vectors are one node that
carries the smallest ids an answer can need, so copies cost nothing and cannot
fill a block. Queries and nodes are hashed into blocks; every (query block, item
block) pair is one cogroup group, which emits only its local top-k per query (no
row pairs are ever materialised). Pairs are scored in single precision and, where
its error bound leaves a chance, again in double precision. A final per-query ``row_number`` (bounded: k candidates per item
block) keeps the global top-k. Scores are rounded to ``SCORE_DIGITS`` before
they are compared and ties go to the smaller item id, so the result does not
depend on the blocks.

Cost model: the block counts follow the row counts, so a task's memory does not
grow with the data: two blocks of vectors plus one tile of scores. Each side is
shuffled once per block of the other side; blocks grow to ``block_rows`` before
there are more of them. Every node is scored against every query; :func:`cell_topk` and
:mod:`facetspark.operators.lsh` bound that work instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.text import _let
from facetspark.session import store

LEAST_ROWS, MOST_ROWS = 2048, 65536  # rows of a block: up to 32 MB of 64 doubles
_TASKS = 6  # groups a core
_PARTIAL_SCHEMA = "qid long, nid long, score double, at int"
_PARTIAL_TYPES = {"qid": np.int64, "nid": np.int64, "score": np.float64, "at": np.int32}
Buckets = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
_TILE, _FIRST = (256, 2048), 1024  # queries and items scored at once (2 MB; more queries of fewer items), and the items of the first tile
_WAIT = 1 << 19  # pairs that wait for double precision
_MANY, _GATHER = 16, 16384  # pairs of a row, for each kept, beyond which it is scored whole; pairs scored at once
SCORE_DIGITS = 9
Sides = tuple[DataFrame, DataFrame]


def text_vector(text: Column, dims: int = 32) -> Column:
    """Word counts in ``dims`` buckets by MD5 of the lower-cased word: integers, the same in any engine. No text: all 0."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    spots = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dims)))
    # the words are hashed once a row, not once a bucket
    return _let(spots, lambda at: F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
                                              lambda b: F.size(F.filter(at, lambda s: s == b)).cast("double")))


def bad_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[int, int]:
    """(rows whose vector is null or holds null or non-finite parts, ids that have several different vectors)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    by_id = df.select(F.col(id_col).alias("id"), usable.alias("ok"), F.xxhash64(v).alias("h")).groupBy("id").agg(
        F.sum((~F.col("ok")).cast("bigint")).alias("bad"), (F.min("h") != F.max("h")).cast("bigint").alias("several"))
    r = by_id.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("several"), F.lit(0)).alias("several")).first()
    return r["bad"], r["several"]


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, side: str) -> DataFrame:
    """``id, vec`` with one row per id, stored; raises with their counts where :func:`bad_vectors` finds any."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec"), (~ok).cast("bigint").alias("bad"), F.xxhash64(v).alias("h"))
    one = store(rows.groupBy("id").agg(F.first("vec").alias("vec"), F.sum("bad").alias("bad"),
                                       (F.min("h") != F.max("h")).cast("bigint").alias("several")), "vectors")
    r = one.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("several"), F.lit(0)).alias("several")).first()
    if r["bad"] or r["several"]:
        raise ValueError(f"{side}: {r['bad']} rows without a usable vector, {r['several']} ids with different vectors")
    return one.select("id", "vec")


def vector_nodes(items: DataFrame, keep: int) -> DataFrame:
    """``vec, ids`` of the distinct vectors of ``id, vec``, each with its ``keep`` smallest ids ascending, stored.

    The smallest ids are found before the shuffle (a partial top-k), so a vector that a
    third of all items share is a few rows of each task.
    """
    first = Window.partitionBy("vec").orderBy("id")
    few = items.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep)
    return store(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "vec"), "nodes")


def _pair_scores(qm: np.ndarray, tm: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded dot products of the pairs, the same for a pair in whatever block it stands."""
    out = np.empty(len(row))
    for a in range(0, len(row), _GATHER):
        out[a:a + _GATHER] = np.einsum("ij,ij->i", qm[row[a:a + _GATHER]], tm[col[a:a + _GATHER]])
    return out.round(SCORE_DIGITS)


class _Nearest:
    """The ``kept`` best items of every query of a block, over all the items that it has met.

    Scores are first taken in single precision, whose error has a bound. Only pairs that come
    within the bound of a query's last kept score are scored in double precision and compared.
    """

    def __init__(self, qm: np.ndarray, tm: np.ndarray, kept: int):
        self.qm, self.tm, self.kept = qm, tm, kept
        self.val, self.col = np.full((len(qm), kept), -np.inf), np.full((len(qm), kept), len(tm))
        # beyond this size single precision could overflow
        kind = np.float32 if max(np.abs(qm).max(), np.abs(tm).max()) < 1e15 else np.float64
        self.q, self.t = qm.astype(kind), tm.astype(kind)
        # d products and sums and the rounded entries, each wrong by half an eps of |q||t| at most; twice that
        self.error = np.linalg.norm(qm, axis=1) * (qm.shape[1] + 8) * np.finfo(kind).eps
        self.length = np.linalg.norm(tm, axis=1)
        size = _TILE[0] * _TILE[1]
        self.scores, self.hit = np.empty(size, kind), np.empty(size, bool)  # used again: fresh pages cost more than the products
        self.wait, self.waiting = [], 0  # pairs to score in double precision, and their number

    def meet(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Score the queries ``rows`` against the items ``cols`` (ascending), tile by tile. Tiles widen as the scores to beat rise."""
        a, width = 0, _FIRST
        while a < len(cols):
            self._strip(rows, cols[a:a + width])
            self._settle()
            a += width
            width = min(_TILE[1], a)

    def meet_in_buckets(self, asked: np.ndarray, who: np.ndarray, held: np.ndarray) -> None:
        """Score every query ``who`` against the items of its bucket ``asked``; ``held`` is the bucket of each item.

        A pair shares one bucket at most. The scores to beat rise after all buckets, not after each: there are many and most are small.
        """
        by, held_by = np.argsort(asked, kind="stable"), np.argsort(held, kind="stable")
        asked_at, who, held_at = asked[by], who[by], held[held_by]
        both = np.intersect1d(asked_at, held_at)
        q, t = (np.searchsorted(x, [both, both + 1]).T for x in (asked_at, held_at))
        for (qa, qb), (ta, tb) in zip(q.tolist(), t.tolist()):
            for a in range(ta, tb, _TILE[1]):
                self._strip(who[qa:qb], held_by[a:min(tb, a + _TILE[1])])
        self._settle()

    def _strip(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Score ``rows`` against one tile's items; the pairs that may be kept wait for :meth:`_settle`."""
        t, length = self.t[cols].T, self.length[cols].max()
        step = len(self.scores) // len(cols)
        for s in range(0, len(rows), step):
            self._tile(rows[s:s + step], cols, t, length)
            if self.waiting > _WAIT:
                self._settle()

    def _tile(self, rows: np.ndarray, cols: np.ndarray, t: np.ndarray, length: float) -> None:
        shape = len(rows), len(cols)
        scores, hit = (x[:shape[0] * shape[1]].reshape(shape) for x in (self.scores, self.hit))
        np.matmul(self.q[rows], t, out=scores)
        error = self.error[rows] * length + 2 * 10.0 ** -SCORE_DIGITS
        least = self.val[rows, -1] - error
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(cols) >= self.kept:
            at = len(cols) - self.kept
            least[new] = np.partition(scores[new], at, axis=1)[:, at] - 2 * error[new]
        hit = np.flatnonzero(np.greater_equal(scores, least.astype(scores.dtype)[:, None], out=hit))
        if not len(hit):
            return
        row, col = np.divmod(hit, len(cols))
        many = np.bincount(row, minlength=len(rows)) > max(_MANY * self.kept, len(cols) // 16)
        if many.any():  # ties or errors beyond counting: the whole rows in double precision, of ties the first
            few = ~many[row]
            row, col = [row[few]], [col[few]]
            dense = np.flatnonzero(many)
            at = len(cols) - min(self.kept, len(cols))
            for d in (dense[a:a + _TILE[0]] for a in range(0, len(dense), _TILE[0])):
                exact = (self.qm[rows[d]] @ self.tm[cols].T).round(SCORE_DIGITS)
                last = np.partition(exact, at, axis=1)[:, at][:, None]
                tie = exact == last
                r, c = np.nonzero((exact > last) | (tie & (np.cumsum(tie, axis=1) <= self.kept)))
                row.append(d[r])
                col.append(c)
            row, col = np.concatenate(row), np.concatenate(col)
        self.wait.append((rows[row], cols[col]))
        self.waiting += len(row)

    def _settle(self) -> None:
        """Score the waiting pairs in double precision and keep, of a query's kept and new pairs, the best, ties to the smaller item."""
        if not self.waiting:
            return
        row, col = (np.concatenate(x) for x in zip(*self.wait))
        self.wait, self.waiting = [], 0
        new = (self.col[row] != col[:, None]).all(axis=1)  # a pair may meet in several tables
        row, col = row[new], col[new]
        val = _pair_scores(self.qm, self.tm, row, col)
        met = np.unique(row)
        row, col, val = np.concatenate([row, np.repeat(met, self.kept)]), np.concatenate([col, self.col[met].ravel()]), np.concatenate([val, self.val[met].ravel()])
        order = np.lexsort((col, -val, row))
        row, col, val = row[order], col[order], val[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.kept
        self.col[met], self.val[met] = col[first].reshape(-1, self.kept), val[first].reshape(-1, self.kept)


def _block_topk(k: int, exclude_self: bool, buckets: Buckets | None = None):
    """Of a block of queries and one of items, as frames or Arrow tables, each query's best ``k``."""
    kept = k + 1 if exclude_self else k  # nodes and ids that an answer can need

    def found(q: dict, t: dict) -> dict:
        (tm, _), (ids, size), qid = t["vec"], t["ids"], q["qid"]
        by_id = np.argsort(ids[np.cumsum(size) - size], kind="stable")
        at, size, tm = (np.cumsum(size) - size)[by_id], size[by_id], tm.reshape(len(size), -1)[by_id]
        qm = q["vec"][0].reshape(len(qid), -1)
        best = _Nearest(qm, tm, min(kept, len(tm)))
        if "buckets" in q:  # a query meets the items of its buckets only
            asked, n = q["buckets"]
            best.meet_in_buckets(asked, np.repeat(np.arange(len(n)), n), t["bucket"][by_id])
        elif buckets:
            for met in buckets(qm, tm):
                best.meet_in_buckets(*met)
        else:
            best.meet(np.arange(len(qm)), np.arange(len(tm)))
        row, j = np.nonzero(best.val > -np.inf)
        col, val = best.col[row, j], best.val[row, j]
        # the nodes' ids, without the query's own, in the same order
        n = size[col]
        nid = ids[np.repeat(at[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        row, val = np.repeat(row, n), np.repeat(val, n)
        other = nid != qid[row] if exclude_self else np.ones(len(nid), bool)
        row, val, nid = row[other], val[other], nid[other]
        order = np.lexsort((nid, -val, row))
        row, val, nid = row[order], val[order], nid[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return {"qid": qid[row[keep]], "nid": nid[keep], "score": val[keep], "at": q["at"][row[keep]]}

    def fn(q, t):
        frames = isinstance(q, pd.DataFrame)
        out = found(_arrays(q), _arrays(t)) if len(q) and len(t) else {c: np.zeros(0) for c in ("qid", "nid", "score", "at")}
        out = {c: np.asarray(x, _PARTIAL_TYPES[c]) for c, x in out.items()}
        return pd.DataFrame(out) if frames else pa.table(out)
    return fn


def _arrays(block: pd.DataFrame | pa.Table) -> dict:
    """The columns as arrays; a list column as its entries strung together and the lists' lengths. Vectors must be equally long."""
    if isinstance(block, pd.DataFrame):
        block = pa.table({c: pa.array(block[c]) for c in block})
    out = {}
    for name in block.column_names:
        x = block[name].combine_chunks()
        if pa.types.is_list(x.type):
            n = np.diff(x.offsets.to_numpy())
            if name == "vec" and (n != n[0]).any():
                raise ValueError(f"vectors of {n.min()} to {n.max()} dimensions")
            x = x.flatten().to_numpy(zero_copy_only=False)
            out[name] = (np.asarray(x, np.float64 if name == "vec" else np.int64), n)
        else:
            out[name] = x.to_numpy(zero_copy_only=False)
    return out


def block_rows(dims: int) -> int:
    """The most rows of a block: 4 million numbers."""
    return max(1024, min(MOST_ROWS, (1 << 22) // max(1, dims)))


def blocked_topk(q: DataFrame, nodes: DataFrame, keys: tuple[str, ...], k: int, exclude_self: bool,
                 query_rows: int | None = None, item_rows: int | None = None, buckets: Buckets | None = None) -> DataFrame:
    """Local top-k of every ``qid, vec`` row among the ``ids, vec`` rows of its ``keys``: ``qid, nid, score, at``.

    A key's rows are dealt into blocks of about ``query_rows`` and ``item_rows``, every
    query block meeting every item block, so a hot key is many groups. Without them the
    blocks are as large as leaves ``_TASKS`` groups a core, but at most ``block_rows``:
    each side is shuffled once per block of the other. ``at`` is that column of the queries,
    or 0. With columns ``buckets`` in ``q`` and ``bucket`` in ``nodes`` a query meets the
    items of its buckets only. So it does with the function ``buckets``, which a block gives
    its query and item vectors: each time ``(bucket, query, the items' buckets)``.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q if "at" in q.columns else q.withColumn("at", F.lit(0))
    asked = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"), F.max(F.size("vec")).alias("_d"))
    counts = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tn"))
    grid = store(counts.join(asked, list(keys)) if keys else counts.crossJoin(asked), "blocks")
    r = grid.agg(F.max("_d").alias("d"), F.sum(F.col("_qn").cast("double") * F.col("_tn")).alias("pairs")).first()
    groups = _TASKS * q.sparkSession.sparkContext.defaultParallelism
    rows = int(min(block_rows(r["d"] or 1), max(LEAST_ROWS, ((r["pairs"] or 0) / groups) ** 0.5)))
    blocks = lambda n, of: F.greatest(F.lit(1), F.ceil(F.col(n) / (of or rows))).cast("long")
    grid = grid.select(*keys, blocks("_tn", item_rows).alias("_tbs"), blocks("_qn", query_rows).alias("_qbs"))
    n = int(grid.agg(F.sum(F.col("_tbs") * F.col("_qbs")).alias("n")).first()["n"] or 1)
    parts = min(4 * n, max(4 * groups, n // 4))  # few groups, each long, should not share a part
    if keys:
        q, t = q.join(grid, list(keys)), nodes.join(grid, list(keys))
    else:
        n = grid.first()
        q, t = (x.withColumn("_tbs", F.lit(n["_tbs"])).withColumn("_qbs", F.lit(n["_qbs"])) for x in (q, nodes))
    by = (*keys, "_qb", "_tb")
    q = q.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("_qbs"))).withColumn("_tb", each("_tbs"))
    t = t.withColumn("_tb", F.pmod(F.xxhash64("ids"), F.col("_tbs"))).withColumn("_qb", each("_qbs"))
    q = q.select(*by, "qid", "at", "vec", *(c for c in q.columns if c == "buckets")).repartition(parts, *by)
    t = t.select(*(F.col(c).alias(c) for c in (*by, "ids", "vec", *(c for c in t.columns if c == "bucket")))).repartition(parts, *by)
    return q.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_block_topk(k, exclude_self, buckets), _PARTIAL_SCHEMA)


def _best(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("nid").asc())
    return (partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", F.col("rank").cast("bigint").alias("rank"), "nid", "score"))


def topk_neighbours(queries: DataFrame, items: DataFrame, k: int = 5, id_col: str = "id",
                    vec_col: str = "embedding", exclude_self: bool = True,
                    query_rows: int | None = None, item_rows: int | None = None, sides: Sides | None = None) -> DataFrame:
    """Exact top-k by dot product -> ``(qid, rank, nid, score)``; rank is 1-based.

    An id names one vector: exact copies count once, and different vectors of one
    id, or vectors that are null or hold null or non-finite parts, raise with
    their counts (see :func:`bad_vectors`) instead of vanishing. ``sides`` are the
    :func:`vector_sides` of the same arguments, where several searches share them.
    """
    q, nodes = sides or vector_sides(queries, items, k, id_col, vec_col, exclude_self)
    return _best(blocked_topk(q, nodes, (), k, exclude_self, query_rows, item_rows), k)


def vector_sides(queries: DataFrame, items: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
                 exclude_self: bool = True) -> Sides:
    """What a search for ``k`` neighbours reads: the checked queries ``qid, vec`` and the items' ``vector_nodes``, both stored."""
    t = usable_vectors(items, id_col, vec_col, "items")
    q = t if queries is items else usable_vectors(queries, id_col, vec_col, "queries")
    return q.withColumnRenamed("id", "qid"), vector_nodes(t, k + 1 if exclude_self else k)


def fit_cells(items: DataFrame, cells: int, vec_col: str = "embedding", sample_rows: int = 50_000, seed: int = 1) -> np.ndarray:
    """Centres of ``cells`` k-means cells, fitted on at most about ``sample_rows`` items (by a hash of the vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample_rows / max(1, items.count()))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sample = items.where(F.pmod(F.xxhash64(v), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector(v).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    return np.array(model.clusterCenters())


def cell_scores(queries: DataFrame, items: DataFrame, centres: np.ndarray, probes: int, k: int = 5, id_col: str = "id",
                vec_col: str = "embedding", exclude_self: bool = True, query_rows: int | None = None, item_rows: int | None = None,
                sides: Sides | None = None) -> DataFrame:
    """Local top-k by dot product in each of a query's ``probes`` nearest cells: ``qid, nid, score, at``, the nearest cell at 0, stored.

    The cell table is small (``len(centres)`` vectors). A cell's queries and items
    are dealt into blocks of bounded size, so a hot cell is several groups; every
    block answers with its local top-k. ``sides`` as in :func:`topk_neighbours`.
    """
    q, t = sides or vector_sides(queries, items, k, id_col, vec_col, exclude_self)
    norm = (centres * centres).sum(axis=1)

    @F.pandas_udf("array<int>")
    def nearest(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()).astype(np.float64) if len(vec) else np.zeros((0, centres.shape[1]))
        far = norm[None, :] - 2 * (x @ centres.T)
        return pd.Series(list(np.argsort(far, axis=1, kind="stable").astype(np.int32)))

    q = q.select("qid", "vec", F.posexplode(F.slice(nearest("vec"), 1, probes)).alias("at", "_c"))
    t = t.withColumn("_c", F.element_at(nearest("vec"), 1))
    return store(blocked_topk(q, t, ("_c",), k, exclude_self, query_rows, item_rows), "cell-scores")


def cell_topk(queries: DataFrame, items: DataFrame, centres: np.ndarray, probes: int, k: int = 5, id_col: str = "id",
              vec_col: str = "embedding", exclude_self: bool = True, query_rows: int | None = None, item_rows: int | None = None,
              scored: DataFrame | None = None) -> DataFrame:
    """Top-k by dot product among the items of each query's ``probes`` nearest cells (all cells: exact).

    ``probes`` is a parameter and never follows the data's size. ``scored`` is the
    ``cell_scores`` of the same search at as many probes or more: several probe counts
    share one scoring.
    """
    if scored is None:
        scored = cell_scores(queries, items, centres, probes, k, id_col, vec_col, exclude_self, query_rows, item_rows)
    return _best(scored.where(F.col("at") < probes), k)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``n_exact`` neighbours in the exact lists, ``n_found`` of them found, ``recall``."""
    hit = exact.select("qid", "nid").join(found.select("qid", "nid", F.lit(1).alias("hit")), ["qid", "nid"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn(
        "recall", F.round(F.col("n_found") / F.col("n_exact"), 6))


def neighbour_lists(topk: DataFrame) -> DataFrame:
    """``(qid, rank, nid)`` -> ``(id, neighbour_ids)`` in rank order (group size <= k)."""
    return topk.groupBy("qid").agg(
        F.sort_array(F.collect_set(F.struct("rank", "nid")))["nid"]
        .alias("neighbour_ids")).withColumnRenamed("qid", "id")


def explode_neighbours(lists: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored neighbour lists -> ``(qid, rank, nid)``; rank is the list position (1-based)."""
    return lists.select(F.col(id_col).alias("qid"),
                        F.posexplode("neighbour_ids").alias("rank", "nid")) \
                .withColumn("rank", (F.col("rank") + 1).cast("bigint"))
