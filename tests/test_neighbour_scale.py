from __future__ import annotations

import numpy as np
import pandas as pd

from facetspark.operators import retrieval as RT


def _frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


def test_probe_counts_share_one_scoring(spark, monkeypatch):
    from facetspark.plans import queries as Q
    calls, real = [], RT.blocked_topk
    monkeypatch.setattr(RT, "blocked_topk", lambda *a, **b: calls.append(a[2]) or real(*a, **b))
    got = [tuple(r) for r in Q.q_cell_recall(spark, "/root/testdata/sf0.001").collect()]
    assert calls == [(), ("_c",)] or calls == [("_c",), ()]  # the exact lists and the cells, each scored once
    assert sorted(got) == [(4, 2500, True), (6, 2500, True), (8, 2500, True)]


def test_shared_scores_give_each_probe_count_its_own_lists(spark):
    m = np.random.default_rng(2).normal(size=(200, 6))
    df = _frame(spark, m)
    centres = RT.fit_cells(df, 5)
    scored = RT.cell_scores(df, df, centres, 5, 3)
    for probes in (1, 3, 5):
        alone = sorted(map(tuple, RT.cell_topk(df, df, centres, probes, 3).collect()))
        assert sorted(map(tuple, RT.cell_topk(df, df, centres, probes, 3, scored=scored).collect())) == alone


def _local(qm, tm, k, **more):
    q = pd.DataFrame({"qid": np.arange(len(qm)), "at": 0, "vec": list(qm), **more})
    t = pd.DataFrame({"ids": [[i] for i in range(len(tm))], "vec": list(tm)})
    return RT._block_topk(k, False)(q, t)


def _brute(qm, tm, k):
    scores = np.array([[float(q @ t) for t in tm] for q in qm]).round(RT.SCORE_DIGITS)
    return [[int(j) for j in np.lexsort((np.arange(len(tm)), -s))[:k]] for s in scores]


def test_single_precision_only_sorts_out():
    rng = np.random.default_rng(7)
    near = rng.normal(size=8) + rng.normal(size=(3000, 8)) * 1e-8  # alike in single precision
    mixed = rng.normal(size=(3000, 8)) * 10.0 ** rng.integers(-3, 4, size=(3000, 1))
    ties = rng.integers(0, 2, size=(3000, 8)).astype(float)
    huge = rng.normal(size=(3000, 8)) * 1e30
    for m in (near, mixed, ties, np.zeros((3000, 8)), rng.normal(size=(3000, 8)), huge):
        found = _local(m[:300:10], m, 5)
        assert found.groupby("qid", sort=True)["nid"].agg(list).tolist() == _brute(m[:300:10], m, 5)


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    m = np.random.default_rng(8).normal(size=(6000, 16))
    pairs, real = [], RT._pair_scores
    monkeypatch.setattr(RT, "_pair_scores", lambda q, t, row, col: pairs.append(len(row)) or real(q, t, row, col))
    _local(m[:500], m, 5)
    assert sum(pairs) < 500 * 6000 / 50
