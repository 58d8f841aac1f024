from __future__ import annotations

import pytest

from facetspark.operators.pairing import pair_by_id, pair_by_position
from facetspark.operators.tokens import pad_truncate, token_ids, word_vocab


def test_pad_truncate_fixtures(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [1, 2, 3, 4, 5]), (3, [])], "i int, ids array<bigint>")
    ids, mask = pad_truncate("ids", 4)
    got = {r.i: (list(r.a), list(r.m)) for r in df.select("i", ids.alias("a"), mask.alias("m")).collect()}
    assert got[1] == ([5, 6, 0, 0], [1, 1, 0, 0])
    assert got[2] == ([1, 2, 3, 4], [1, 1, 1, 1])
    assert got[3] == ([0, 0, 0, 0], [0, 0, 0, 0])


def test_word_vocab_and_token_ids(spark):
    docs = spark.createDataFrame([(1, "b a  c\tb"), (2, "  "), (3, "c")], "id long, text string")
    vocab = word_vocab(docs, "text")
    assert sorted((r.word, r.wid) for r in vocab.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    toks = {r.id: (r.n_tokens, list(r.ids)) for r in token_ids(docs, "id", "text", vocab, 3).collect()}
    assert toks == {1: (4, [2, 1, 3]), 2: (0, []), 3: (1, [3])}


def test_pair_by_position_truncates_and_strict_raises(spark):
    d = spark.createDataFrame([(3, "d2"), (1, "d0"), (2, "d1")], "k int, data string")
    lab = spark.createDataFrame([(20, "l1"), (10, "l0")], "j int, label string")
    out = pair_by_position(d, lab, ["k"], ["j"])
    assert sorted((r.pos, r.data, r.label) for r in out.collect()) == [(0, "d0", "l0"), (1, "d1", "l1")]
    with pytest.raises(ValueError):
        pair_by_position(d, lab, ["k"], ["j"], strict=True)


def test_pair_by_id_data_side_wins(spark):
    d = spark.createDataFrame([(1, "x", None), (2, "y", "keep")], "id long, a string, shared string")
    s = spark.createDataFrame([(1, "L1", "from_label"), (2, "L2", "lost"), (3, "L3", "z")],
                              "id long, label string, shared string")
    got = sorted(tuple(r) for r in pair_by_id(d, s).select("id", "a", "shared", "label").collect())
    assert got == [(1, "x", "from_label", "L1"), (2, "y", "keep", "L2")]


def test_seq2seq_pairs_rendering(spark):
    from facetspark.operators.pairing import seq2seq_pairs
    d = spark.createDataFrame([(1, "cog", None, 12345678.0), (2, "nut", "acme", 4.5), (3, "x", "y", 1.0)],
                              "id long, description string, retailer string, price double")
    s = spark.createDataFrame([(1, "B1"), (2, None)], "id long, brand string")
    got = {r.id: (r.input_text, r.target_text) for r in seq2seq_pairs(d, s, ["description", "retailer", "price"],
                                                                      ["brand"]).collect()}
    assert got == {1: ("description: cog retailer: None price: 12345678.0", "brand: B1"),
                   2: ("description: nut retailer: acme price: 4.5", "brand: None")}


def test_instruction_records_and_prompts(spark):
    from facetspark.operators.instructions import PROMPT_PREFIX, instruction_prompts, instruction_records
    df = spark.createDataFrame([(1, "q?", "a.")], "k int, u string, a string")
    r = instruction_records(df, "u", "a").first()
    assert (r.k, r.input, r.output) == (1, "q?", "a.")
    kept = instruction_records(df, "u", "a", keep_newline=True).first()
    assert (kept.input, kept.output) == ("q?\n", "a.\n")
    p = instruction_prompts(instruction_records(df, "u", "a"), "instruction", "input").first().prompt
    assert p.startswith(PROMPT_PREFIX) and p.endswith('"input":"q?"}')


def test_token_ids_with_copies(spark):
    docs = spark.createDataFrame([(1, "b a c")] * 40 + [(2, "c c")], "id long, text string")
    vocab = word_vocab(docs, "text")
    got = sorted((r.id, r.n_tokens, list(r.ids)) for r in token_ids(docs, "id", "text", vocab, 2).collect())
    assert got == [(1, 3, [2, 1])] * 40 + [(2, 2, [3, 3])]


def test_token_ids_of_two_texts_and_rare_words(spark):
    docs = spark.createDataFrame([(1, "t", "a b a", "c"), (1, "v", None, "b b"), (2, "t", "", "a")], "id long, split string, x string, y string")
    vocab = word_vocab(docs.selectExpr("explode(array(x, y)) AS t"), "t")
    for hot in (0, 1, 10):  # no word, one word, all words by broadcast
        out = token_ids(docs, "id", ["x", "y"], vocab, [2, 5], keep=["split"], hot_words=hot)
        assert sorted((r.id, r.split, r.n_x, list(r.ids_x), r.n_y, list(r.ids_y)) for r in out.collect()) == [
            (1, "t", 3, [1, 2], 1, [3]), (1, "v", 0, [], 2, [2, 2]), (2, "t", 0, [], 1, [1])]


def test_data_side_wins_by_key_presence(spark):
    d = spark.createDataFrame([(1, None, {"brand": None}), (2, None, {}), (3, "own", {"brand": "own"}), (4, None, None)], "id long, brand string, fields map<string,string>")
    s = spark.createDataFrame([(i, f"L{i}") for i in range(1, 5)], "id long, brand string")
    got = {r.id: r.brand for r in pair_by_id(d, s, fields="fields").collect()}
    assert got == {1: None, 2: "L2", 3: "own", 4: "L4"}


def test_strict_pairing_allows_spare_labels(spark):
    d, lab = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "j")
    assert pair_by_position(d, lab, ["k"], ["j"], strict=True).count() == 3
