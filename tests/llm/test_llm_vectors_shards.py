"""Whitening, hard negatives and sharding against plain numpy and Python, and over awkward rows."""
from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import hard_negatives, shard_shuffle, whitening
from facetspark.llm.hard_negatives import mine_hard_negatives
from facetspark.llm.shard_shuffle import shuffled_shards
from facetspark.llm.whitening import whitened_components

CLASH = ("id", "x", "n", "part", "v", "tag", "size", "shard", "slot", "row", "rank", "component", "asks", "number")


# --- whitening -----------------------------------------------------------------

def vectors(kind: str, d: int = 12, n: int = 200) -> np.ndarray:
    r = np.random.default_rng(5)
    x = r.normal(size=(n, d)) * np.linspace(1, 4, d)
    if kind == "copies":
        x[n // 3:] = x[0]
    if kind == "thin":  # fewer directions than dimensions, many equal eigenvalues
        x[:, 3:] = 0
    if kind == "square":
        x = np.vstack([np.eye(d), -np.eye(d)] * 3)
    return np.floor(64 * x)


@pytest.mark.parametrize("kind", ["plain", "copies", "thin", "square"])
def test_rank_one_updates_give_the_spectrum(kind):
    x = vectors(kind)
    s, halves = whitening.Spectrum.empty(x.shape[1]), [whitening.Spectrum.empty(x.shape[1]) for _ in range(2)]
    for i, v in enumerate(x):
        s.add(v)
        halves[i % 2].add(v)
    halves[0].merge(halves[1])
    around = x - x.mean(axis=0)
    scatter = around.T @ around
    for one in (s, halves[0]):
        assert one.n == len(x) and np.allclose(one.mean, x.mean(axis=0))
        assert np.allclose(one.vectors.T @ one.vectors, np.eye(x.shape[1]), atol=1e-12)
        assert np.allclose(one.vectors * one.values @ one.vectors.T, scatter, atol=1e-9 * np.trace(scatter))
    distinct, times = np.unique(x, axis=0, return_counts=True)
    t = whitening.Spectrum.empty(x.shape[1])
    for v, k in zip(distinct, times.tolist(), strict=True):
        t.add(v, k)
    assert np.allclose(t.vectors * t.values @ t.vectors.T, scatter, atol=1e-9 * np.trace(scatter))


def test_secular_roots_lie_between_the_poles():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        d = np.sort(r.uniform(0, 1, n)) + np.arange(n) * 1e-9
        weight = r.uniform(1e-12, 1, n) ** 4 + 1e-14
        roots, gaps = whitening.secular(d, weight)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all()
        assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(weight), np.sqrt(weight)))), roots, rtol=1e-12)
        assert (np.sign(gaps) == np.where(np.arange(n)[:, None] > np.arange(n)[None, :], 1, -1)).all()


def plain_whitening(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    whole = [[int(c) for c in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    deviation = [sum((len(x) * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in whole]
    return values, (x - x.mean(axis=0)) @ axes / np.sqrt(values), deviation


def test_whitening_equals_numpy(spark):
    x = vectors("plain") / 64 + 0.003
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    out = whitened_components(df, components=8).toPandas()
    whole = np.floor(64 * x) + 1_000_000
    values, white, deviation = plain_whitening(whole, 8)
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-8)
    assert out.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation
    assert np.allclose(out.groupby("component")["explained"].first(), values / np.trace(np.cov(whole.T, bias=True)))
    assert out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9 and set(out["n"]) == {200}


def test_whitening_takes_awkward_rows(spark):
    good = [[1.0, 2.0, 0.5], [3.0, -1.0, 0.5], [0.0, 4.0, 0.5], [3.0, -1.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, [1.0, 1.0, 0.5]), (3, [3.0, -1.0, 0.5])] + [(9, v) for v in bad] + [(20, [1.0]), (21, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in CLASH})
    out = whitened_components(df).collect()
    assert Counter(r.vec_id for r in out) == {0: 3, 1: 3, 2: 3, 3: 6, None: 3, 20: 1, 21: 1}
    three = [r for r in out if r.vec_id not in (20, 21)]
    assert {r.n for r in three} == {6} and all((r.whitened is None) == (r.component == 3) for r in three)
    assert all(r.explained == 0 for r in three if r.component == 3) and max(r.identity_error for r in out) < 1e-9
    one = whitened_components(df.where("vec_id = 0")).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    assert whitened_components(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert not whitened_components(df.limit(0)).collect()


def test_whitening_of_large_numbers_stays_exact(spark):
    x = [[1e12, 3.0], [-2e12, 5.0], [5e11, 1.0]]
    out = whitened_components(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for v in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in whole]
    assert min(want) >= 1 << 63 and all(r.deviation is None for r in out)
    assert max(abs(w - round(w, 6)) for w in (r.explained for r in out)) < 1


# --- hard negatives --------------------------------------------------------------

def clustered(n: int = 240, d: int = 20, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, r.randrange(4), [c + r.uniform(-.3, .3) for c in r.choice(centres)]) for i in range(n)]
    return rows + [(n + i, lab, rows[7][2]) for i, lab in enumerate([0, 1, 2, 3] * 10)]  # ties


def whole(rows):
    return [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows]


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 17)])
def test_hard_negatives_are_the_definition(spark, blocks):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    out = mine_hard_negatives(df, F.col("vec_id") % 9 == 0, anchor_rows=blocks[0], item_rows=blocks[1])
    want = hard_negatives.brute_force(whole(rows), lambda i: i % 9 == 0)
    assert want and sorted(map(tuple, out.collect())) == sorted(want)


def test_segment_bounds_hold_and_drop_pairs():
    r = np.random.default_rng(1)
    for d in (1, 3, 4, 16, 21, 64):
        x = np.floor(r.normal(size=(30, d)) * 100 + r.normal(size=(1, d)) * 100)
        fine = hard_negatives.summaries(x, hard_negatives.levels_of(d)[-1])
        score = x @ x.T
        widths = []
        for s in hard_negatives.levels_of(d):
            long, m, dev = hard_negatives.coarser(*fine, d, s)
            exact = hard_negatives.summaries(x, s)
            assert np.allclose(m, exact[0]) and np.allclose(dev, exact[1])
            middle, reach = (m * long) @ m.T, dev @ dev.T
            assert (np.abs(score - middle) <= reach * (1 + 1e-9) + 1e-6).all()
            widths.append(reach.sum())
        assert all(a >= b - 1e-6 for a, b in zip(widths, widths[1:], strict=False))


def test_bounds_spare_exact_scores():
    import pyarrow as pa

    # neighbouring dimensions alike, as in smooth signals: segment means say most
    r = np.random.default_rng(6)
    x = np.floor(np.repeat(r.normal(size=(440, 8)) * 100, 4, axis=1) + r.normal(size=(440, 32)) * 5)
    rows = [(i, 0, v.astype(int).tolist()) for i, v in enumerate(x)]
    means, deviations = hard_negatives.summaries(x, 16)
    side = hard_negatives._Side(pa.table({"id": [i for i, _, _ in rows], "x": x.astype(int).tolist(), "means": means.tolist(), "deviations": deviations.tolist()}))
    counts: dict = {}
    who = np.arange(40)
    i, j, score = hard_negatives.best_in_range(side, side, who, np.full(40, -1e15), np.full(40, 1e15), 5, lambda w: w[:, None] != np.arange(len(rows))[None, :], counts)
    exact = (x @ x.T)[:40]
    exact[who, who] = -np.inf
    assert (np.sort(score.reshape(40, 5)) == np.sort(exact)[:, -5:]).all()
    assert counts["pairs"] == 40 * 440 and counts["scored"] < counts["pairs"] / 10


def test_hard_negatives_take_awkward_rows(spark):
    rows = clustered(60, 8)
    odd = [(None, 1, rows[0][2]), (500, None, rows[0][2]), (501, 1, None), (502, 1, []), (503, 1, [1.0, None] * 4), (504, 1, [float("nan")] * 8),
           (505, 1, [float("-inf")] * 8), (0, rows[0][1], rows[0][2])]
    short = [(900 + i, i % 2, [0.5 + i / 9]) for i in range(6)]
    huge = [(950, 0, [1e300] * 3), (951, 0, [1e300] * 3), (952, 1, [9e299] * 3)]
    df = spark.createDataFrame(rows + odd + short + huge, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("z") for c in CLASH})
    out = sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 9 == 0).collect()))
    want = hard_negatives.brute_force(whole(rows), lambda i: i % 9 == 0) + hard_negatives.brute_force(whole(short), lambda i: i % 9 == 0)
    assert out == sorted(want)
    assert not mine_hard_negatives(df.limit(0), F.col("vec_id") % 9 == 0).collect()
    assert not mine_hard_negatives(df, F.lit(False)).collect()


# --- sharding ----------------------------------------------------------------------

def test_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(4)
    for good, bad, n in ((5, 7, 6), (1, 9, 3), (30, 4, 20), (3, 3, 6)):
        seen = Counter(shard_shuffle.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= good and n - k <= bad else 0
            assert abs(seen[k] / 4000 - p) < 5 * math.sqrt(p * (1 - p) / 4000) + 1e-9, (good, bad, n, k)
    big = [shard_shuffle.hypergeometric(rng, 10**12, 3 * 10**12, 10**9) for _ in range(60)]
    assert abs(np.mean(big) - 2.5e8) < 6 * 13_700 / math.sqrt(60) and 9_000 < np.std(big) < 19_000


def test_matrix_has_the_margins():
    rng = np.random.default_rng(1)
    m = shard_shuffle.communication_matrix(rng, [7, 0, 100, 1], [27, 27, 27, 27])
    assert m.sum(axis=1).tolist() == [7, 0, 100, 1] and (m.sum(axis=0) == 27).all() and (m >= 0).all()


def test_permutations_are_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in (0, 1, 99):
            p = shard_shuffle.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == list(range(n))
    first = [tuple(shard_shuffle.permuted(np.arange(4), np.full(4, 4), np.full(4, k)).tolist()) for k in range(4800)]
    seen = Counter(first)
    assert len(seen) == 24 and sum((c - 200) ** 2 / 200 for c in seen.values()) < 50  # 23 degrees of freedom


def test_shards_are_a_uniform_shuffle(spark):
    df = spark.range(0, 60, 1, 3).select(F.col("id").alias("doc_id"))
    at = np.zeros((60, 60))
    shards = np.zeros((60, 7))
    for seed in range(20):
        out = shuffled_shards(df, shards=7, seed=seed, cell_rows=4, part_bits=3).select("row.doc_id", "shard", "slot").collect()
        sizes = Counter(r.shard for r in out)
        assert sorted(sizes.values(), reverse=True) == [9] * 4 + [8] * 3 and len({r.doc_id for r in out}) == 60
        for s, n in sizes.items():
            assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
        for r in out:
            shards[r.doc_id, r.shard] += 1
            at[r.doc_id, r.shard * 9 + r.slot - max(0, r.shard - 4)] += 1
    assert (at.sum(axis=0) == 20).all()
    expected = 20 * np.array([9] * 4 + [8] * 3) / 60
    assert ((shards - expected) ** 2 / expected).sum() < 360 + 5 * math.sqrt(2 * 360)  # about 59 x 6 degrees of freedom


def test_sharding_takes_awkward_rows(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "é🙂"), (None, None), (4, "long " * 50000)] + [(9, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in CLASH})
    out = shuffled_shards(df, shards=5)
    again = shuffled_shards(df, shards=5)
    got = [(r["row"].doc_id, r["row"].text, r.shard, r.slot) for r in out.collect()]
    assert Counter(g[:2] for g in got) == Counter(rows) and sorted(Counter(g[2] for g in got).values()) == [9, 9, 9, 10, 10]
    assert got == [(r["row"].doc_id, r["row"].text, r.shard, r.slot) for r in again.collect()]
    assert out.select("row.*").columns == df.columns
    shard_shuffle.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and {"row_shard", "row_slot", "shard", "slot", "text"} <= set(back.columns)
    assert shuffled_shards(df.limit(0), shards=5).collect() == []
    few = shuffled_shards(df.limit(2), shards=5).collect()
    assert len(few) == 2 and sorted(r.shard for r in few) == [0, 1]
