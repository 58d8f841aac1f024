from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.operators.fewshot import fewshot_examples, fill_prompt, knn_vote, vote_share, with_examples
from facetspark.operators.retrieval import (bad_vectors, cell_topk, explode_neighbours, fit_cells, neighbour_lists, recall_at_k,
                                            text_vector, topk_neighbours)


def _brute(qids, qm, tids, tm, k, exclude_self):
    out = []
    for qi, qv in zip(qids, qm):
        sc = [(-(float(qv @ tv)), int(ti)) for ti, tv in zip(tids, tm) if not (exclude_self and ti == qi)]
        sc.sort()
        out += [(int(qi), r + 1, ti, -s) for r, (s, ti) in enumerate(sc[:k])]
    return sorted(out)


def test_topk_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    # small integer vectors -> many exact score ties, broken by the smaller id
    m = rng.integers(-2, 3, size=(300, 8)).astype(float)
    ids = np.arange(300) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id long, embedding array<double>")
    for exclude_self, rows in ((True, (500, 500)), (True, (100, 75)), (False, (150, 150))):
        got = topk_neighbours(df, df, 5, exclude_self=exclude_self, query_rows=rows[0], item_rows=rows[1])
        got = sorted((r.qid, r.rank, r.nid, r.score) for r in got.collect())
        assert got == _brute(ids, m, ids, m, 5, exclude_self)


def test_bad_vectors_are_reported(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert bad_vectors(df, "id", "embedding") == (3, 1)
    with pytest.raises(ValueError, match="3 rows .* 1 ids"):
        topk_neighbours(df, df, 2)
    good = df.where("id = 1")
    assert [(r.qid, r.nid) for r in topk_neighbours(good, good, 2, exclude_self=False).collect()] == [(1, 1)]


def test_cells_are_exact_when_all_are_probed(spark):
    rng = np.random.default_rng(9)
    m = rng.integers(-3, 4, size=(240, 6)).astype(float)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    centres = fit_cells(df, 6)
    expect = _brute(range(240), m, range(240), m, 4, True)
    got = cell_topk(df, df, centres, probes=6, k=4, query_rows=20, item_rows=15)
    assert sorted((r.qid, r.rank, r.nid, r.score) for r in got.collect()) == expect
    one = recall_at_k(cell_topk(df, df, centres, probes=1, k=4), got).first()
    assert one.n_exact == 960 and 0 < one.recall < 1


def test_text_vectors_count_hashed_words(spark):
    df = spark.createDataFrame([("a b  A",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(text_vector(F.col("t"), 16).alias("v")).collect()]
    assert sorted(got[0])[-2:] == [1.0, 2.0] and sum(got[0]) == 3 and got[1] == got[2] == [0.0] * 16


def test_every_query_gets_a_prompt_row(spark):
    q = spark.createDataFrame([(100,), (200,)], "id long")
    ex = spark.createDataFrame([(100, "E", 2)], "qid long, learning_input string, n_examples bigint")
    assert sorted(tuple(r) for r in with_examples(q, ex).collect()) == [(100, "E", 2), (200, "", 0)]


def test_repeated_train_rows_are_repeated_examples(spark):
    nb = spark.createDataFrame([(100, 1, 3)], "qid long, rank bigint, nid long")
    train = spark.createDataFrame([(3, "d", "b")] * 2, "id long, description string, brand string")
    r = fewshot_examples(nb, train, ["description"], ["brand"]).first()
    assert r.n_examples == 2 and r.learning_input.count("output:") == 2


def test_neighbour_lists_roundtrip(spark):
    t = spark.createDataFrame([(1, 1, 7), (1, 2, 3), (2, 1, 9)], "qid long, rank bigint, nid long")
    lists = neighbour_lists(t)
    assert {r.id: list(r.neighbour_ids) for r in lists.collect()} == {1: [7, 3], 2: [9]}
    back = sorted(tuple(r) for r in explode_neighbours(lists).collect())
    assert back == [(1, 1, 7), (1, 2, 3), (2, 1, 9)]


def test_fewshot_examples_order_modes(spark):
    nb = spark.createDataFrame([(100, 1, 3), (100, 2, 1)], "qid long, rank bigint, nid long")
    train = spark.createDataFrame([(1, "d1", "b1"), (3, "d3", "b3")], "id long, description string, brand string")
    sim = fewshot_examples(nb, train, ["description"], ["brand"]).first()
    assert sim.learning_input == ('input: {"description":"d3"}\noutput: {"brand":"b3"}\n\n'
                                  'input: {"description":"d1"}\noutput: {"brand":"b1"}')
    assert sim.n_examples == 2
    by_train = fewshot_examples(nb, train, ["description"], ["brand"], order="train").first()
    assert by_train.learning_input.startswith('input: {"description":"d1"}')


def test_fill_prompt_does_not_reexpand_slot_text(spark):
    df = spark.createDataFrame([("has {test_input} inside", "T")], "a string, b string")
    r = df.select(fill_prompt("A:{learning_input}|B:{test_input}|{{x}}",
                              {"learning_input": F.col("a"), "test_input": F.col("b")}).alias("p")).first()
    assert r.p == "A:has {test_input} inside|B:T|{x}"


def test_knn_vote_ties_and_share(spark):
    nb = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 12), (2, 3, 11)],
                               "qid long, rank bigint, nid long")
    lab = spark.createDataFrame([(10, 5), (11, 4), (12, 5), (1, 4), (2, 5)], "id long, label int")
    got = {r.qid: (r.predicted, r.votes) for r in knn_vote(nb, lab).collect()}
    assert got == {1: (4, 1), 2: (5, 2)}
    share = {r.qid: r.p_true for r in vote_share(nb, lab, lab).collect()}
    assert share == {1: 0.5, 2: 2 / 3}


def test_topk_with_copies_equals_distinct_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 6))
    ids = np.arange(120)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, m)]
    copies = rows + [rows[0]] * 60 + [rows[7]] * 30  # one id repeated as a third of the table
    df = spark.createDataFrame(copies, "id long, embedding array<double>")
    got = sorted((r.qid, r.rank, r.nid, round(r.score, 9)) for r in
                 topk_neighbours(df, df, 4, query_rows=40, item_rows=60).collect())
    assert got == [(a, b, c, round(d, 9)) for a, b, c, d in _brute(ids, m, ids, m, 4, True)]
