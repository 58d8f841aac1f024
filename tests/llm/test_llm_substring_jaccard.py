from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from facetspark.llm import hashing, jaccard_join, substring_dedup
from facetspark.llm.components import connected_components


def texts(seed, n, words):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 8, 40, 90]))]
        if i and r.random() < 0.6:
            other = out[r.randrange(i)].split(" ")
            a = r.randrange(len(other))
            t = (other[:a] + t[:3] + other[a:]) if r.random() < 0.5 else t + other[a:a + 60]
        out.append(r.choice([" ", " ", "\n"]).join(t))
    return out


@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0céZ", max_size=30), max_size=8), st.booleans())
@settings(max_examples=60, deadline=None)
def test_words_are_found_in_every_row(rows, fold):
    buf, offs = hashing.text_buffer(pa.array(rows, pa.string()))
    got, at = hashing.word_hashes(buf, offs, fold)
    expect = [t.encode().split() for t in rows]
    assert np.diff(at).tolist() == [len(x) for x in expect]
    flat = [w for x in expect for w in x]
    if fold:
        flat = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in flat]
    assert len(set(flat)) == len(set(got.tolist())) and len(dict(zip(flat, got.tolist(), strict=True))) == len(set(flat))


def test_window_hashes_equal_only_for_equal_windows():
    x = np.random.default_rng(0).integers(0, 3, 500).astype(np.uint64)
    for k in (1, 2, 5, 7, 35):
        h = hashing.window_hashes(hashing.mix(x), k, 0x5851F42D4C957F2D)
        seq = [tuple(x[i:i + k].tolist()) for i in range(len(x) - k + 1)]
        assert len(h) == len(seq) and len(set(zip(seq, h.tolist(), strict=True))) == len(set(seq)) == len(set(h.tolist()))


def test_long_word_crosses_the_buffer_window():
    big = "x" * (hashing.WINDOW + 10)
    h, at = hashing.word_hashes(*hashing.text_buffer(pa.array([f"a {big} b", big])))
    assert at.tolist() == [0, 3, 4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_substring_dedup_is_the_definition(spark):
    rows = texts(3, 120, 60) + [None, "", "x " * 200]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # small chunks and buckets: every path crosses tasks
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(df, window=6, chunk_chars=700, bucket_windows=50).collect()}
    for i, (n, gone, digest) in enumerate(substring_dedup.brute_force(rows, 6)):
        r = out[i]
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == (n, gone, digest)
        assert sum(b - a for a, b in r.removed) == gone and all(b < c for (_, b), (c, _) in zip(r.removed, r.removed[1:], strict=False))


def test_repeated_rows_are_held_once(spark, monkeypatch):
    base = texts(7, 12, 30)
    rows = list(enumerate(base)) + [(3, "a b c d e f g h")] * 5000 + [(None, "p q r s t u v")] * 300 + [(None, "short")] * 3 + [(4, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expect = sorted((str(i), n, gone, digest) for (i, _), (n, gone, digest) in zip(rows, substring_dedup.brute_force([t for _, t in rows], 6), strict=True))
    out = substring_dedup.substring_dedup(df, window=6, chunk_chars=700, bucket_windows=50)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()) == expect
    assert out.columns == ["doc_id", "n_words", "n_removed", "removed", "kept_text"]

    stores, sizes = jaccard_join.stored, []

    def watched(df, name="stored"):
        kept = stores(df, name)
        if name == "member-texts":
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard_join, "stored", watched)
    base_text = " ".join(f"w{i}" for i in range(40))
    got = jaccard_join.jaccard_components(spark.createDataFrame([(1, base_text)] * 50 + [(2, base_text + " h")], "doc_id long, text string").repartition(3))
    assert [(r.doc_id, r.component_id) for r in got.orderBy("doc_id").collect()] == [(1, 1)] * 50 + [(2, 1)] and sizes == [2]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in label and b in label and a != b:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == label and got.count() == len(label)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_jaccard_is_the_definition(spark):
    base = texts(5, 60, 40)
    r = random.Random(2)
    near = []
    for i in range(70):  # one group of near copies and chains that link only through others
        w = [f"n{j}" for j in range(60)]
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"e{r.randrange(30)}"
        near.append(" ".join(w))
    chain = [" ".join(f"c{j}" for j in range(i * 3, i * 3 + 40)) for i in range(12)]
    rows = list(enumerate([*base, *near, *chain, "A b C d", "a B c D", "a b c", None, ""], start=10))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = jaccard_join.brute_force(rows)
    for tile in (1 << 20, 300):  # the second cuts parts into tiles
        out = jaccard_join.jaccard_components(df, tile_shingles=tile).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == expect


def test_rows_without_an_id_link_like_others(spark):
    chain = [" ".join(f"c{j}" for j in range(i * 3, i * 3 + 40)) for i in range(9)]
    alone = [" ".join(f"n{j}" for j in range(i, i + 50)) for i in range(4)]
    rows = [(None if i % 3 else 20 - i, t) for i, t in enumerate(chain)]  # named texts link only through unnamed ones
    rows += [(None, t) for t in alone] * 2 + [(None, alone[0].upper()), (None, "far away"), (None, None), (None, ""), (5, None), (6, "x y"), (None, "X y")]
    known = [(100 + n if i is None else i, t) for n, (i, t) in enumerate(rows)]
    expect = jaccard_join.brute_force(known)
    assert {expect[i][1] for i, t in known if t in chain} == {14}
    expect = sorted((i is None, i or 0, n, c if c < 100 else -1) for (i, _), (n, c) in zip(rows, (expect[k] for k, _ in known), strict=True))
    for kind, tile in (("string", 1 << 20), ("long", 60)):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        out = jaccard_join.jaccard_components(df, tile_shingles=tile).collect()
        assert sorted((x.doc_id is None, int(x.doc_id or 0), x.n_shingles, -1 if x.component_id is None else int(x.component_id)) for x in out) == expect
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = [(str(x.doc_id), "alone" if x.text and x.text.lower() in alone else x.text) for x in kept]
    assert sorted(kept, key=str) == sorted([("14", chain[6]), ("None", "alone"), ("None", "far away"), ("None", None), ("None", ""), ("5", None), ("6", "x y")], key=str)



def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 200, 400)
    points = np.stack([np.bincount(rng.integers(0, 32, n), minlength=32) for n in sizes]).astype(np.int32)
    tree = jaccard_join.CountVectorTree(points, sizes)
    for i in range(0, 400, 7):
        found, bound = tree.search(points[i], int(sizes[i]), 3, 4)
        low = np.minimum(points, points[i]).sum(axis=1)
        ok = (low * 7 >= 3 * (sizes + sizes[i])) & (sizes * 4 >= 3 * sizes[i]) & (sizes * 3 <= 4 * sizes[i])
        assert sorted(found.tolist()) == np.flatnonzero(ok).tolist() and (bound == low[found]).all()
