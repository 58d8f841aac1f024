"""Every dealt operator over the same awkward rows: nulls, empty and very long texts, ties, repeats, no rows, clashing columns."""
from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from facetspark.llm.ann import nearest_neighbours
from facetspark.llm.byte_bpe import bpe_digests
from facetspark.llm.fingerprints import document_fingerprints
from facetspark.llm.jaccard_join import jaccard_components
from facetspark.llm.langid import fit_languages, language_mixtures
from facetspark.llm.mixing import curriculum_mix, training_order
from facetspark.llm.quality import quality_scores
from facetspark.llm.secret_scan import secret_scan
from facetspark.llm.substring_dedup import substring_dedup
from facetspark.llm.url_filter import url_filter

LONG = " ".join(f"word{i % 977}" for i in range(30000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "a"), (7, "the quick brown fox jumps over the lazy dog"),
    (7, "the quick brown fox jumps over the lazy dog"), (None, "no id at all"), (None, None), (8, "password = abcdefgh12 \U0001F600 é"), (9, "1234 !!"),
]
# names that the operators use inside
CLASH = ("id", "key", "n", "part", "chunk", "bucket", "hash", "spans", "kinds", "score", "digest", "position", "label", "crc", "copy", "tile")


def docs(spark, rows=TEXTS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 4, "s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH}) if clash else df


def labels(spark, rows=((1, 1), (5, 1), (6, 0), (9, 0), (9, 0), (None, 1), (3, None), (4, 7))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def language(spark, d):
    return language_mixtures(d, fit_languages(d.select(F.col("doc_id").alias("id"), "text", "lang")))


BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PER_ROW = {
    "language": language,
    "bpe": lambda spark, d: bpe_digests(d, *BPE),
    "quality": lambda spark, d: quality_scores(d, labels(spark)),
    "fingerprints": lambda spark, d: document_fingerprints(d),
    "jaccard": lambda spark, d: jaccard_components(d),
    "substring": lambda spark, d: substring_dedup(d),
    "secrets": lambda spark, d: secret_scan(d),
    "mixing": lambda spark, d: curriculum_mix(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(spark, name):
    out = PER_ROW[name](spark, docs(spark)).collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_extra_columns_change_nothing(spark, name):
    plain, clash = (sorted(map(str, PER_ROW[name](spark, docs(spark, clash=c)).collect())) for c in (False, True))
    assert plain == clash


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_no_rows(spark, name):
    out = PER_ROW[name](spark, docs(spark, []))
    assert out.collect() == [] and len(out.columns) > 1


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_null_row(spark, name):
    assert len(PER_ROW[name](spark, docs(spark, [(None, None)])).collect()) == 1


def test_training_order_keeps_the_columns(spark):
    d = docs(spark)
    out = training_order(d)
    assert out.columns == d.columns
    assert out.where("text IS NULL OR trim(text) = ''").count() == 0


def test_urls(spark):
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (2, None), (3, ""), (4, "no scheme"), (5, "://"), (None, "http://B.NET/es/1?q#f"), (6, "http://" + "h" * 50000 + ".org/" + "p" * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in (*CLASH, "host", "path", "rule", "verdict", "html")})
    out = url_filter(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[None].host, by[None].path, by[None].rule, by[None].verdict) == ("b.net", "/es/1", "net/es/", "block")
    assert all((by[i].host, by[i].path, by[i].rule) == ("", "", None) for i in (2, 3, 4, 5))
    assert url_filter(df.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (50, [1.0, 0.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in (*CLASH, "v", "size", "shard", "block", "query_id")})
    out = sorted(tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (50, 1, 9)]
    assert [r[3] for r in out[:3]] == [1.0, 1.0, -1.0]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
