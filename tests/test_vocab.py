from __future__ import annotations

from pyspark.sql import functions as F

from facetspark.operators.indexing import dense_index, zip_index
from facetspark.operators.vocab import (build_vocab, compact_vocab, decode_labels, drop_missing, encode_labels,
                                        label_cardinality)


def test_vocab_is_sorted_bijection(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, "c", None), (4, "a", "y")],
                               "id long, brand string, module string")
    v = build_vocab(df, ["brand", "module"])
    got = sorted((r.attr, r.label, r.idx) for r in v.collect())
    assert got == [("brand", "a", 0), ("brand", "b", 1), ("brand", "c", 2), ("module", "x", 0), ("module", "y", 1)]
    assert sorted(tuple(r) for r in label_cardinality(df, ["brand", "module"]).collect()) == [("brand", 3), ("module", 2)]


def test_compact_vocab_fixtures(spark):
    df = spark.createDataFrame([("a", "m"), ("na", "na"), ("b", "z"), ("c", "z")], "p string, q string")
    v = compact_vocab(build_vocab(df, ["p", "q"]))
    got = sorted((r.attr, r.label, r.idx) for r in v.collect())
    assert got == [("p", "a", 0), ("p", "b", 1), ("p", "c", 2), ("q", "m", 0), ("q", "z", 1)]


def test_drop_missing_keeps_null(spark):
    df = spark.createDataFrame([(1, "na"), (2, None), (3, "x")], "id long, brand string")
    assert sorted(r.id for r in drop_missing(df, "brand").collect()) == [2, 3]


def test_encode_unknown_modes_and_decode(spark):
    vsrc = spark.createDataFrame([(1, "a"), (2, "b")], "id long, brand string")
    vocab = build_vocab(vsrc, ["brand"])
    df = spark.createDataFrame([(10, "b"), (11, "zz")], "id long, brand string")
    as_null = {r.id: r.idx for r in encode_labels(df, vocab, ["brand"]).collect()}
    as_zero = {r.id: r.idx for r in encode_labels(df, vocab, ["brand"], unknown="zero").collect()}
    dropped = [r.id for r in encode_labels(df, vocab, ["brand"], unknown="drop").collect()]
    assert as_null == {10: 1, 11: None}
    assert as_zero == {10: 1, 11: 0}
    assert dropped == [10]
    dec = decode_labels(encode_labels(df, vocab, ["brand"]), vocab, out_col="decoded")
    assert {r.id: r.decoded for r in dec.collect()} == {10: "b", 11: None}


def test_zip_index_dense_and_ordered(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(13)
    out = zip_index(df, ["k"], "pos", num_partitions=6).collect()
    assert sorted((r.k, r.pos) for r in out) == [(i, i) for i in range(n)]
    again = zip_index(df, ["k"], "pos", num_partitions=6, start=1).collect()
    assert sorted((r.k, r.pos) for r in again) == [(i, i + 1) for i in range(n)]


def test_zip_index_does_not_lean_on_exchange_reuse(spark):
    """Over a million rows with a map column, exchange reuse off: every position exactly once, in order."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.create_map(F.lit("m"), F.col("id")).alias("extra"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = zip_index(df, ["k"], "pos", num_partitions=9)
        r = out.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.sum((F.col("pos") != F.col("k")).cast("int")).alias("wrong")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r.n, r.d, r.wrong) == (n, n, 0)


def test_zip_index_orders_ties_of_nested_maps(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), F.array(F.create_map(F.lit("a"), F.array("id"))).alias("m"))
    a = {str(r.m): r.pos for r in zip_index(df, ["k"], "pos", num_partitions=3).collect()}
    assert a == {str(r.m): r.pos for r in zip_index(df.repartition(5), ["k"], "pos", num_partitions=3).collect()}


def test_dense_index_without_broadcast(spark):
    df = spark.createDataFrame([(g, v) for g in "abc" for v in "xyz"], "g string, v string")
    a, b = (sorted(map(tuple, dense_index(df, "g", "v", broadcast_groups=n).collect())) for n in (0, 10))
    assert a == b == [(g, v, i) for g in "abc" for i, v in enumerate("xyz")]


def test_dense_index_equals_dense_rank(spark):
    data = [(g, f"v{(i * 37) % 50:03d}") for g in ("a", "b", "c") for i in range(200)]
    df = spark.createDataFrame(data, "g string, v string")
    got = sorted((r.g, r.v, r.idx) for r in dense_index(df, "g", "v", num_partitions=4).collect())
    expect = []
    for g in ("a", "b", "c"):
        vals = sorted({v for gg, v in data if gg == g})
        expect += [(g, v, i) for i, v in enumerate(vals)]
    assert got == sorted(expect)


def test_zip_index_ties_are_content_ordered(spark):
    df = spark.createDataFrame([(1, f"t{i:03d}") for i in range(300)], "k int, v string").repartition(7)
    a = {r.v: r.pos for r in zip_index(df, ["k"], "pos", num_partitions=4).collect()}
    b = {r.v: r.pos for r in zip_index(df.repartition(3), ["k"], "pos", num_partitions=4).collect()}
    assert a == b and sorted(a.values()) == list(range(300))
