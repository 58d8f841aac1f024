from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from facetspark.operators.extract import parse_reply
from facetspark.operators.merge import merge_attributes, to_long
from facetspark.operators.models import argmax, fit_linear_head, generate, majority_label, score_linear_head

REPLIES = [
    (1, '{"result": "\\n{\\"brand\\": \\"B\\"}"}', '{"brand": "B"}', "B"),
    (2, '{"result": "\\noutput: {\\"brand\\": \\"B\\", \\"module\\": \\"M\\"} extra"}',
     '{"brand": "B", "module": "M"}', "B"),
    (3, '{"result": "no newline"}', None, None),
    (4, '{"result": "\\n{\\n \\"brand\\": \\"B\\"\\n}"}', "", None),
    (5, '{"result": "\\n } {\\"brand\\": \\"B\\"}"}', "", None),
]


def test_reply_fixtures(spark):
    df = spark.createDataFrame([(i, b) for i, b, _, _ in REPLIES], "id long, body string")
    got = {r.id: (r.cleaned, r.brand) for r in parse_reply(df, "body", "brand string, module string").collect()}
    assert got == {i: (c, b) for i, _, c, b in REPLIES}


def test_merge_fixture(spark):
    long = spark.createDataFrame([(1, "brand", "x", 0), (1, "brand", "y", 1), (1, "group", "g", 0),
                                  (2, "group", "h", 0)], "id long, attr string, value string, seq bigint")
    got = {r.id: r.asDict() for r in merge_attributes(long, ["group", "brand", "module"]).collect()}
    assert got == {1: {"id": 1, "group": "g", "brand": "y", "module": None},
                   2: {"id": 2, "group": "h", "brand": None, "module": None}}


def test_to_long(spark):
    df = spark.createDataFrame([(7, "v")], "indoml_id long, brand string")
    assert tuple(to_long(df, "brand", 3, id_col="indoml_id").first()) == (7, "brand", "v", 3)


def test_majority_label_ties_to_smaller(spark):
    df = spark.createDataFrame([("r", "b", "x"), ("r", "a", "x"), ("r", "b", "y"), ("s", "c", None)],
                               "k string, p string, q string")
    got = sorted(tuple(r) for r in majority_label(df, "k", ["p", "q"]).collect())
    assert got == [("r", "p", "b"), ("r", "q", "x"), ("s", "p", "c")]


def test_generate_runs_plugin_per_batch(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, txt string").repartition(3)

    def factory():
        return lambda s: s.str.upper() + "!"

    out = generate(df, "txt", factory, batch_rows=7)
    assert sorted((r.id, r.generated) for r in out.collect()) == [(i, f"T{i}!") for i in range(50)]


def test_registered_generator_is_found_by_name(spark):
    df = spark.createDataFrame([(1, 'output: {"b":"x"}'), (2, "junk"), (3, None)], "id long, txt string")
    got = {r.id: r.generated for r in generate(df, "txt", "vote_json").collect()}
    assert got == {1: '{"b": "x"}', 2: None, 3: None}
    with pytest.raises(KeyError):
        generate(df, "txt", "no such model")


def test_linear_head_separable(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    model = fit_linear_head(df, "embedding", "label", max_iter=50)
    scored = score_linear_head(model, df, "embedding")
    assert all(r.prediction == r.id % 2 for r in scored.collect())


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],), ([2.0],)], "a array<double>")
    assert [r[0] for r in df.select(argmax(F.col("a"))).collect()] == [1, 0]


def test_prompt_vote_and_reply_roundtrip(spark):
    example = 'input: {"d":"x"}\noutput: {"brand":"%s","m":"%s"}'
    prompt = "intro\n\n" + "\n\n".join(example % x for x in (("C", "q"), ("B", "r"), ("B", "q"), ("C", "q")))
    df = spark.createDataFrame([(1, prompt), (2, "no examples"), (3, "output: {broken}")], "id long, p string")
    text = {r.id: r.generated for r in generate(df, "p", "vote_text").collect()}
    assert text == {1: "brand: B m: q", 2: None, 3: None}  # brand ties: the smaller one
    replies = generate(df, "p", "vote_reply", out_col="reply")
    got = {r.id: (r.brand, r.m) for r in parse_reply(replies, "reply", "brand string, m string", keep_clean=False)
           .collect()}
    assert got == {1: ("B", "q"), 2: (None, None), 3: (None, None)}


def test_corrupt_replies_keep_their_text(spark):
    bad = '{"result": "\\n{not json}"}'
    df = spark.createDataFrame([(1, '{"result": "\\n{\\"brand\\": null}"}'), (2, bad), (3, "no marker"), (4, None)], "id long, body string")
    got = {r.id: (r.brand, r._corrupt) for r in parse_reply(df, "body", "brand string", keep_corrupt=True).collect()}
    assert got == {1: (None, None), 2: (None, bad), 3: (None, "no marker"), 4: (None, None)}


def test_merge_ties_take_the_larger_value(spark):
    long = spark.createDataFrame([(1, "brand", v, 0) for v in ("b", "c", "a")], "id long, attr string, value string, seq bigint")
    for n in (1, 3):
        assert merge_attributes(long.repartition(n), ["brand"]).first().brand == "c"


def test_too_many_classes_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 10, 3_000_000)], "id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="too many"):
        fit_linear_head(df, "embedding", "label")


def test_fit_per_attribute_parallel(spark):
    from facetspark.operators.models import fit_per_attribute
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2, 1 - i % 2 if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, a int, b int")
    models = fit_per_attribute(df, "embedding", ["a", "b"], parallelism=2, max_iter=30)
    assert set(models) == {"a", "b"}
    sa = {r.id: r.prediction for r in score_linear_head(models["a"], df, "embedding").collect()}
    sb = {r.id: r.prediction for r in score_linear_head(models["b"], df, "embedding").collect()}
    assert all(sa[i] == i % 2 and sb[i] == 1 - i % 2 for i in range(40))
