"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their value; each shard
builds its graph in a Python task and keeps it as flat arrays: the neighbours of node
i on a layer are row i of an integer matrix, padded with -1. Every query searches
every shard's graph and the shards' best are merged by exact cosine. The shard
number follows the row count, so a shard's memory and build time stay bounded.

Equal vectors are one node, which carries the smallest ids of its copies (one more
than a query asks for, as a query may be a copy itself): copies cannot crowd the
graph, and no copy that could be an answer is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


class Graph:
    """Layered proximity graph over unit vectors, built by insertion; neighbours are flat arrays."""

    def __init__(self, unit: np.ndarray, links: int = 16, beam: int = 80, seed: int = 1):
        n = len(unit)
        self.unit, self.links, self.beam = unit, links, beam
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.uniform(1e-12, 1, n)) / np.log(links)).astype(int), 12)
        self.neighbours = [np.full((n, 2 * links if h == 0 else links), -1, np.int32) for h in range(int(level.max()) + 1 if n else 1)]
        self.degree = [np.zeros(n, np.int32) for _ in self.neighbours]
        self.seen, self.mark = np.zeros(n, np.int64), 0
        self.entry, self.top = 0, int(level[0]) if n else 0
        for i in range(1, n):
            self._insert(i, int(level[i]))

    def _insert(self, i: int, level: int) -> None:
        q, at = self.unit[i], self.entry
        for h in range(self.top, level, -1):
            at = self._descend(q, at, h)
        near = [(float(self.unit[at] @ q), at)]
        for h in range(min(self.top, level), -1, -1):
            near = self._search(q, [x for _, x in near], h, self.beam)
            picked = self._spread(near, self.links)
            self.neighbours[h][i, :len(picked)] = picked
            self.degree[h][i] = len(picked)
            for j in picked:
                self._link(j, i, h)
        if level > self.top:
            self.entry, self.top = i, level

    def _link(self, j: int, i: int, h: int) -> None:
        row, d = self.neighbours[h], self.degree[h]
        if d[j] < row.shape[1]:
            row[j, d[j]] = i
            d[j] += 1
            return
        around = np.append(row[j], i)
        score = self.unit[around] @ self.unit[j]
        order = np.argsort(-score, kind="stable")
        picked = self._spread(list(zip(score[order].tolist(), around[order].tolist(), strict=True)), row.shape[1])
        row[j] = -1
        row[j, :len(picked)] = picked
        d[j] = len(picked)

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, those nearer to a picked one than to the centre later; filled up to ``most``."""
        if len(near) <= most:
            return [x for _, x in near]
        ids = np.array([x for _, x in near])
        between = self.unit[ids] @ self.unit[ids].T
        score = np.array([s for s, _ in near])
        picked: list[int] = []
        hidden = np.zeros(len(ids), bool)
        for k in range(len(ids)):
            if not hidden[k]:
                picked.append(k)
                if len(picked) == most:
                    break
                hidden |= between[k] > score
        if len(picked) < most:
            rest = np.setdiff1d(np.arange(len(ids)), picked)
            picked += rest[:most - len(picked)].tolist()
        return ids[picked].tolist()

    def _descend(self, q: np.ndarray, at: int, h: int) -> int:
        best = float(self.unit[at] @ q)
        while True:
            around = self.neighbours[h][at, :self.degree[h][at]]
            if not len(around):
                return at
            score = self.unit[around] @ q
            k = int(np.argmax(score))
            if score[k] <= best:
                return at
            best, at = float(score[k]), int(around[k])

    def _search(self, q: np.ndarray, starts: list[int], h: int, beam: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest found on a layer, nearest first."""
        self.mark += 1
        mark, seen, unit = self.mark, self.seen, self.unit
        row, degree = self.neighbours[h], self.degree[h]
        score = unit[starts] @ q
        seen[starts] = mark
        todo = [(-s, x) for s, x in zip(score.tolist(), starts, strict=True)]
        found = [(-s, x) for s, x in todo]
        heapq.heapify(todo)
        heapq.heapify(found)
        while todo:
            s, x = heapq.heappop(todo)
            if len(found) >= beam and -s < found[0][0]:
                break
            around = row[x, :degree[x]]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            for v, y in zip((unit[around] @ q).tolist(), around.tolist(), strict=True):
                if len(found) < beam:
                    heapq.heappush(found, (v, y))
                    heapq.heappush(todo, (-v, y))
                elif v > found[0][0]:
                    heapq.heapreplace(found, (v, y))
                    heapq.heappush(todo, (-v, y))
        return sorted(found, reverse=True)

    def search(self, q: np.ndarray, beam: int) -> list[int]:
        at = self.entry
        for h in range(self.top, 0, -1):
            at = self._descend(q, at, h)
        return [x for _, x in self._search(q, [at], 0, beam)]


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                       shard_rows: int = 4000, links: int = 16, build_beam: int = 80, search_beam: int = 100, query_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that meets the condition ``queries``.

    Nearness is the cosine in double precision; ties go to the smaller id; all
    candidates are returned if there are fewer than ``k``. A row is never its own
    neighbour; other rows of its id are neither. Vectors that are null, zero or
    empty, or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths are never compared. Repeated rows (same id
    and vector) count once. Extra columns are not read.

    Recall depends on the beams only: every vector is indexed in one shard, and every
    query searches all shards, in blocks of ``query_rows``.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = stored(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    # copies of one vector: the smallest k + 1 ids, found before the shuffle where they can be
    first = Window.partitionBy("v").orderBy("id")
    nodes = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    nodes = nodes.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.withColumn("size", F.size("v")).withColumn("hash", F.xxhash64("v")), "nodes")
    sizes = nodes.groupBy("size").count().collect()
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = {r["size"]: -(-r["count"] // shard_rows) for r in sizes}
    shard_of = F.create_map(*(x for d, n in shards.items() for x in (F.lit(d), F.lit(n))))
    nodes = nodes.withColumn("shard", F.pmod("hash", shard_of[F.col("size")].cast("long")))
    asked = rows.where("asks").select("id", "v", F.size("v").alias("size")).distinct()
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shard_of[F.col("size")].cast("long") - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)))

    def build(df: pa.Table) -> pa.Table:
        df = df.sort_by("hash")
        unit = _unit(_matrix(df["v"]))
        g = Graph(unit, links, build_beam)
        return pa.table({"size": df["size"][:1], "shard": df["shard"][:1], "entry": pa.array([g.entry], pa.int32()), "top": pa.array([g.top], pa.int32()),
                         "layers": pa.array([[x.tobytes() for x in g.neighbours]], pa.list_(pa.binary())),
                         "vectors": pa.array([_matrix(df["v"]).tobytes()], pa.binary()), "ids": pa.array([df["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})

    graphs = nodes.groupBy("size", "shard").applyInArrow(
        build, "size int, shard long, entry int, top int, layers array<binary>, vectors binary, ids array<array<long>>")
    graphs = stored(graphs, "graphs")
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if len(shard) and len(asked):
            size = shard["size"][0].as_py()
            vectors = np.frombuffer(shard["vectors"][0].as_py(), np.float64).reshape(-1, size)
            g = Graph.__new__(Graph)
            g.unit, g.entry, g.top = _unit(vectors), shard["entry"][0].as_py(), shard["top"][0].as_py()
            g.neighbours = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in shard["layers"][0].as_py()]
            g.degree = [(x >= 0).sum(axis=1) for x in g.neighbours]
            g.seen, g.mark = np.zeros(len(vectors), np.int64), 0
            ids = shard["ids"][0].as_py()
            own = _matrix(asked["v"])
            unit = _unit(own)
            norm = np.sqrt((vectors * vectors).sum(axis=1))
            for q, x, u in zip(asked["id"].to_pylist(), own, unit, strict=True):
                found = np.array(g.search(u, search_beam))
                near = vectors[found]
                score = (near @ x) / (norm[found] * np.sqrt(x @ x))
                score = np.where(np.isfinite(score) & (norm[found] > 0), score, g.unit[found] @ u)
                best = sorted((-s, i) for s, n in zip(score.tolist(), found.tolist(), strict=True) for i in ids[n] if i != q)[:k]
                out[0].extend([q] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = spread.groupBy("size", "shard", "block").cogroup(asked.groupBy("size", "shard", "block")).applyInArrow(
        look, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple[int, list[float]]], queries: Iterator[int], k: int = 5) -> dict[int, list[int]]:
    """Exact neighbours by comparing all vectors (equal lengths, usable values)."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in queries:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = ids[order].tolist()
    return out
