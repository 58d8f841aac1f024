from __future__ import annotations

import numpy as np
import pytest

from facetspark.operators.lsh import fit_lsh, lsh_topk, tune_tables
from facetspark.operators.retrieval import recall_at_k, topk_neighbours, vector_nodes


def _vectors(n=400, d=12, seed=4):
    """Clusters of different lengths, so that the largest dot product is not the smallest angle."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * rng.uniform(0.5, 3, size=(12, 1))
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.3


def _frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


def test_every_probe_finds_everything(spark):
    df = _frame(spark, _vectors(150))
    index = fit_lsh(df, bits=3, tables=1, probes=8)
    got = sorted(map(tuple, lsh_topk(df, df, index, 4, query_rows=40, item_rows=30).collect()))
    assert got == sorted(map(tuple, topk_neighbours(df, df, 4).collect()))


def test_tuned_tables_reach_the_recall(spark):
    items, queries = _frame(spark, _vectors()), _frame(spark, _vectors(60, seed=5), 1000)
    index = tune_tables(queries, items, fit_lsh(items, bits=5, tables=24, probes=3), k=5, target=0.9)
    assert 1 <= index.tables <= 24
    found, exact = lsh_topk(queries, items, index, 5), topk_neighbours(queries, items, 5)
    assert recall_at_k(found, exact).first().recall >= 0.9
    scores = {(r.qid, r.nid): r.score for r in exact.collect()}
    assert all(abs(scores[r.qid, r.nid] - r.score) < 1e-9 for r in found.collect() if (r.qid, r.nid) in scores)
    with pytest.raises(ValueError, match="more tables"):
        tune_tables(queries, items, fit_lsh(items, bits=12, tables=1, probes=1), k=5, target=0.99)


def test_copies_and_empty_sides(spark):
    m = _vectors(30)
    df = _frame(spark, np.vstack([m, np.repeat(m[:1], 300, axis=0)]))
    nodes = vector_nodes(df.withColumnRenamed("embedding", "vec"), 4).collect()
    assert len(nodes) == 30 and max(len(r.ids) for r in nodes) == 4 and [0, 30, 31, 32] in [list(r.ids) for r in nodes]
    index = fit_lsh(df, bits=4, tables=2, probes=16)
    few = df.where("id IN (0, 200)")
    got = sorted(map(tuple, lsh_topk(few, df, index, 8).collect()))
    assert got == sorted(map(tuple, topk_neighbours(few, df, 8).collect())) and len(got) == 16
    assert lsh_topk(df.limit(0), df, index, 3).count() == 0 and lsh_topk(df, df.limit(0), index, 3).count() == 0
    assert topk_neighbours(df.limit(0), df, 3).count() == 0 and topk_neighbours(df, df.limit(0), 3).count() == 0
    zeros = _frame(spark, np.zeros((3, 4)))
    assert lsh_topk(zeros, zeros, fit_lsh(zeros, probes=4, bits=2), 1).count() == 3
    with pytest.raises(ValueError, match="bits"):
        fit_lsh(df, bits=20)
