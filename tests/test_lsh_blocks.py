from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from facetspark.operators import lsh as L
from facetspark.operators import retrieval as RT


def _frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")


def test_few_blocks_look_up_all_tables(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(150, 6))
    df = _frame(spark, np.vstack([m, m[:10]]))
    index = L.fit_lsh(df, bits=4, tables=6, probes=4, vec_col="vec")
    sent, real = [], L.blocked_topk
    monkeypatch.setattr(L, "blocked_topk", lambda q, *a, **b: sent.append(q.count()) or real(q, *a, **b))
    whole = sorted(map(tuple, L.lsh_topk(df, df, index, 3, vec_col="vec").collect()))
    parts = sorted(map(tuple, L.lsh_topk(df, df, index, 3, vec_col="vec", query_rows=40, item_rows=30).collect()))
    assert sent == [160, 160]  # a query once to each block of items, not to each table
    monkeypatch.setattr(L, "_shift", lambda *a: 0)
    assert whole == parts == sorted(map(tuple, L.lsh_topk(df, df, index, 3, vec_col="vec").collect()))
    assert {tuple(r) for r in whole} != {tuple(r) for r in RT.topk_neighbours(df, df, 3, vec_col="vec").collect()}  # it is the index that finds


def test_many_blocks_send_to_groups():
    index = L.Lsh(np.zeros((15, 65, 8)), 1.0, 8)
    assert L._shift(index, 600_000, 600_000) is None and L._shift(index, 1000, 20) is None
    assert L._shift(index, 10 ** 8, 10 ** 8) is not None


@pytest.mark.parametrize(("bits", "probes"), [(1, 1), (1, 2), (3, 8), (5, 3), (8, 8), (8, 60), (12, 9)])
def test_query_buckets_are_the_nearest_of_all(bits, probes):
    rng = np.random.default_rng(bits)
    index, x = L.Lsh(rng.normal(size=(2, 7, bits)), 3.0, probes), rng.normal(size=(50, 6))
    side = index._sides(x, False)
    flips = np.arange(1 << bits)
    cost = (side * side) @ ((flips >> np.arange(bits)[:, None]) & 1)
    own = ((side > 0) << np.arange(bits)).sum(axis=2)
    want = (own[:, :, None] ^ np.argsort(cost, axis=2, kind="stable")[:, :, :probes]) + (np.arange(2) << bits)[:, None, None]
    assert (index.query_buckets(x) == np.moveaxis(want, 0, 1)).all()
    assert L._flips(bits, probes).shape[1] >= probes and (probes > 9 or L._flips(bits, probes).shape[1] <= 2 * probes)


def test_a_later_table_scores_only_what_beats_an_earlier_one(monkeypatch):
    m = np.random.default_rng(6).normal(size=(4000, 16))
    index = L.Lsh(np.random.default_rng(1).normal(size=(12, 17, 5)), float(np.linalg.norm(m, axis=1).max()), 8)
    scored, real = [], RT._pair_scores
    monkeypatch.setattr(RT, "_pair_scores", lambda q, t, row, col: scored.append(len(row)) or real(q, t, row, col))
    q = pa.table({"qid": np.arange(300), "at": np.zeros(300, np.int32), "vec": list(m[:300])})
    t = pa.table({"ids": [[i] for i in range(4000)], "vec": list(m)})
    found = RT._block_topk(5, True, index.meetings)(q, t)
    assert found.num_rows == 300 * 5 and sum(scored) < 300 * 12 * 8
    asked, held = index.query_buckets(m[:300]), index.item_buckets(m)
    got = found.to_pandas().groupby("qid")["nid"].agg(list)
    for i in range(0, 300, 30):
        meets = np.flatnonzero((asked[i][None] == held[:, :, None]).any(axis=(1, 2)) & (np.arange(4000) != i))
        score = (m[meets] @ m[i]).round(RT.SCORE_DIGITS)
        assert got[i] == meets[np.lexsort((meets, -score))[:5]].tolist()


def test_unequal_vectors_raise():
    block = lambda name, first: pa.table({name: first, "at": np.zeros(2, np.int32), "vec": [[1.0], [1.0, 2.0, 3.0]]})
    with pytest.raises(ValueError, match="dimensions"):
        RT._block_topk(1, False)(block("qid", [0, 1]), block("ids", [[0], [1]]))


def test_searches_of_a_query_share_their_sides(spark, monkeypatch):
    from facetspark.plans import queries as Q
    sides, real = [], RT.usable_vectors
    monkeypatch.setattr(RT, "usable_vectors", lambda *a: sides.append(a[3]) or real(*a))
    assert tuple(Q.q_lsh_recall(spark, "/root/testdata/sf0.001").first()) == (2500, True, True)
    assert sides == ["items"]
