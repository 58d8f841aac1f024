from __future__ import annotations

import numpy as np
import pytest

from facetspark.operators import lsh as L


def _frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")


@pytest.mark.parametrize("shift", [0, 2, 5])
def test_a_query_is_sent_once_a_group(spark, shift):
    m = np.random.default_rng(3).normal(size=(40, 6))
    df = _frame(spark, m)
    index = L.fit_lsh(df, bits=5, tables=3, probes=4, vec_col="vec")
    sent = df.select("id", L._query_buckets(index, shift)).collect()
    assert len({(r.id, r._c) for r in sent}) == len(sent) and (shift < 5 or len(sent) == 40 * 3)
    assert all(b >> shift == r._c for r in sent for b in r.buckets)
    asked = {(r.id, b) for r in sent for b in r.buckets}
    assert asked == {(i, int(b)) for i, x in enumerate(index.query_buckets(m)) for b in x.ravel()} and len(asked) == 40 * 3 * 4
    assert df.limit(0).select("id", L._query_buckets(index, shift)).count() == 0



def test_groups_do_not_show_in_the_result(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(120, 6))
    df = _frame(spark, m)
    index = L.fit_lsh(df, bits=4, tables=3, probes=4, vec_col="vec")
    sent, real = [], L.blocked_topk
    monkeypatch.setattr(L, "blocked_topk", lambda q, *a, **b: sent.append(q.count()) or real(q, *a, **b))
    lists = []
    for shift in (0, 4):
        monkeypatch.setattr(L, "_shift", lambda *a, s=shift: s)
        lists.append(sorted(map(tuple, L.lsh_topk(df, df, index, 3, vec_col="vec").collect())))
    assert lists[0] == lists[1] and sent == [120 * 3 * 4, 120 * 3]
