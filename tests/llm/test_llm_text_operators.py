from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import SF_SMOKE
from facetspark.llm import fingerprints as fp
from facetspark.llm import langid, quality, queries
from facetspark.llm.byte_bpe import ByteBPE, bpe_decode, bpe_digests, bpe_encode, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, "rb") as f:
        return ByteBPE(read_ranks(f.read()), PATTERN)


@pytest.fixture(scope="module")
def public(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_the_library(bpe, public):
    r = random.Random(1)
    letters = "aaabcde  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0ñß'sSTtREreVEllLLdDmM0129٣Ⅷ日本語🙂é.,!?-_=+<|endoftext|>\x00"
    rows = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    rows += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(500, 3000))) for _ in range(20)]
    rows += ["ab" * 20000, " " * 30000, "=-" * 5000, "<|endoftext|>", ""]
    for t in rows:
        ids = bpe.encode(t)
        assert ids == public.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_bpe_over_a_frame(spark, bpe):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe_decode(bpe_encode(df, PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in back] == [b"hello world", b"", b""] and back[0].ids == bpe.encode("hello world")
    out = bpe_digests(df, PATH, PATTERN).orderBy("doc_id").collect()
    ids = bpe.encode("hello world")
    assert (out[0].n_tokens, out[0].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert out[1].ids_sha256 == out[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_query_against_the_library(spark, public):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, SF_SMOKE).collect():
        ids = public.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_language_held_out_accuracy(spark):
    out = queries.op1_language_mixture(spark, SF_SMOKE).join(spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_mixture_of_two():
    rng = random.Random(0)
    words = {"x": ["abba", "acab", "baca"], "y": ["zyzz", "yxyz", "xxzy"]}
    text = {k: " ".join(rng.choice(v) for _ in range(400)) for k, v in words.items()}
    n = np.stack([np.bincount(langid.grams(text[k]), minlength=langid.BUCKETS) for k in "xy"], axis=1)
    m = langid.LanguageModel(["x", "y"], ((n + 0.2) / (n.sum(axis=0) + 0.2 * langid.BUCKETS)).astype(np.float32))
    assert m.proportions(text["x"]) == {"x": 1.0}
    both = m.proportions(text["x"][:1000] + " " + text["y"][:500])
    assert set(both) == {"x", "y"} and abs(both["x"] - 2 / 3) < 0.05
    assert m.proportions("123 !") == m.proportions("") == m.proportions(None) == {}
    assert set(m.proportions(text["y"] * 20)) == {"y"}  # long: counted grams


def test_quality_held_out(spark):
    sf = SF_SMOKE.replace("sf0.001", "sf0.01")
    out = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    held = out.where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMOKE}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.quality_scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_pooling_is_isotonic_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x, y, w = np.sort(rng.normal(size=80)), rng.uniform(size=80), rng.integers(1, 9, 80).astype(float)
    knots, values = quality.pool(x, y, w)
    fit = np.interp(x, knots, values)
    assert (np.diff(values) >= 0).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, one).collect()} == {1.0}
    assert {r.score for r in quality.quality_scores(docs, one.limit(0)).collect()} == {0.5}


def test_peeling_recovers_the_differences():
    r = random.Random(4)
    a = [" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([0, 5, 60, 900]))) for _ in range(60)]
    b = [" ".join(t.split()[:-4] + ["new"] * r.randrange(3)) if r.random() < 0.7 else r.choice(a) for t in a]
    x, y = fp.paragraph_digests(a), fp.paragraph_digests(b)
    alike = fp.likeness(x, y)
    for i, (only_a, only_b) in enumerate(fp.differences(x, y, cells=6)):
        p, q = ({*k[o[i]:o[i + 1]].tolist()} for k, o in (x, y))
        assert {*only_a.tolist()} == p - q and {*only_b.tolist()} == q - p
        assert alike[i] == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0)


def test_repeats_and_equal_texts():
    d = fp.paragraph_digests(["a\na\na", "a\na", "a\na\na", "", "x y\nz"])
    f = fp.fingerprint(d)
    assert f[0] == f[2] != f[1] and np.diff(d[1]).tolist()[:4] == [3, 2, 3, 0]


@pytest.mark.parametrize("part_chars", [16 << 20, 200])
def test_fingerprints_against_the_definition(spark, part_chars):
    r = random.Random(2)
    rows = [(i * 3, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(60))) + "é🙂" * r.randrange(3)) for i in range(80)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in fp.document_fingerprints(df, part_chars=part_chars).collect()}
    order = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        e = fp.edited(t, after)
        x = got[i]
        d = fp.paragraph_digests([t, e, after])
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert [x.fingerprint, x.edited_fingerprint] == fp.fingerprint(d)[:2]
        p, q, z = ({*d[0][d[1][k]:d[1][k + 1]].tolist()} for k in range(3))
        assert x.near_edited == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0)
        assert x.near_next == pytest.approx(len(p & z) / len(p | z) if p | z else 1.0)


def test_letters_of_every_plane_count():
    from facetspark.llm.langid import grams

    for letter in ("\U00030000", "\U00031340", "字", "é"):
        assert letter.isalpha() and len(grams(letter * 5)) == 5
    assert len(grams("\U0010fffd 12 \U0001F600")) == 0


def test_em_is_the_plain_iteration():
    """Mixture proportions and log-likelihood against expectation-maximisation written out in plain Python."""
    import math
    import random

    import numpy as np

    from facetspark.llm.langid import _em

    r = random.Random(2)
    p = [[r.uniform(1e-4, 1) for _ in range(3)] for _ in range(50)]
    times = [r.randrange(1, 5) for _ in p]
    n, pi = sum(times), [1 / 3] * 3
    for _ in range(30):
        new = [sum(t * pi[k] * row[k] / sum(a * b for a, b in zip(pi, row, strict=True)) for t, row in zip(times, p, strict=True)) / n for k in range(3)]
        done = max(abs(a - b) for a, b in zip(new, pi, strict=True)) < 2e-3
        pi = new
        if done:
            break
    value = sum(t * math.log(sum(a * b for a, b in zip(pi, row, strict=True))) for t, row in zip(times, p, strict=True))
    got = _em(np.array(p), np.array(times), n)
    assert np.allclose(got[0], pi) and math.isclose(got[1], value)
    flat = [row for t, row in zip(times, p, strict=True) for _ in range(t)]
    assert np.allclose(_em(np.array(flat), None, n)[0], pi)


def test_quality_equations_are_kernel_ridge(spark):
    """Summed normal equations against one plain solve, and the cosines' products against the Gaussian kernel."""
    import numpy as np

    from facetspark.llm.quality import STATS, QualityModel, fit_quality

    rng = np.random.default_rng(1)
    d = len(STATS)
    x = rng.normal(size=(160, d))
    rows = [(i, [float(v) for v in s], int(s[0] + s[1] > 0)) for i, s in enumerate(x)]
    model = fit_quality(spark.createDataFrame(rows, "id long, stats array<double>, label int").repartition(3), features=24)
    from pyspark.sql import functions as F
    held = {r.id for r in spark.range(160).where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(5)) == 0).collect()}
    fit = [i for i in range(160) if i not in held]
    z = model.cosines(x[fit])
    y = np.array([rows[i][2] for i in fit], float)
    plain = np.linalg.solve(z.T @ z + 1e-2 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, plain, atol=1e-8)
    many = 20_000
    wide = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, many)) / 4.0, rng.uniform(0, 2 * np.pi, many), np.zeros(0), np.zeros(0), np.zeros(0), 0.5)
    c = wide.cosines(x[:12])[:, :many]
    apart = ((x[:12, None] - x[None, :12]) ** 2).sum(axis=2)
    assert np.abs(c @ c.T - np.exp(-apart / (2 * 4.0 ** 2))).max() < 0.05


def test_long_urls_take_linear_time(spark):
    import time

    from facetspark.llm.url_filter import url_filter

    base = [(i, f"http://{'news' if i % 2 else 'spam'}{i}.example.com/{'en' if i % 2 else 'x'}/{i}") for i in range(40)]
    df = spark.createDataFrame([*base, (99, "http://a.org/" + "path/" * 200_000), (100, "http://b\U0001F600.org/\U0001F600é")], "page_id long, url string")
    start = time.time()
    out = {r.page_id: r for r in url_filter(df).collect()}
    assert time.time() - start < 90 and len(out[99].path) == 1_000_001 and len(out) == 42


def test_stored_fingerprints_give_back_the_differing_digests(spark):
    """Subtracted and peeled as stored, against the sets of digests; too many differences are told, and recovered from the texts."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from facetspark.llm.fingerprints import fingerprint, fingerprint_difference, paragraph_digests, version_difference

    r = random.Random(8)
    line = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(5)) + "\n"
    pairs = []
    for changed in (0, 1, 2, 4, 60):
        for _ in range(12):
            a = [line() for _ in range(r.randrange(1, 40))]
            b = list(a)
            for _ in range(changed):
                b[r.randrange(len(b))] = line() if r.random() < .7 else ""
            pairs.append(("".join(a), "".join(b) + "".join(line() for _ in range(changed // 3))))
    pairs += [("", ""), ("one", ""), (None, "one two"), ("same line\n" * 30, "same line\n" * 28)]
    texts = [t or "" for p in pairs for t in p]
    marks = fingerprint(paragraph_digests(texts))
    keys, offs = paragraph_digests(texts)
    sets = [set(keys[offs[i]:offs[i + 1]].view(np.int64).tolist()) for i in range(len(texts))]
    df = spark.createDataFrame([(i, a, b, marks[2 * i], marks[2 * i + 1]) for i, (a, b) in enumerate(pairs)], "i int, a string, b string, fa string, fb string")
    rows = df.select("i", fingerprint_difference(F.col("fa"), F.col("fb")).alias("f"), version_difference(F.col("a"), F.col("b")).alias("v")).collect()
    told = 0
    for x in rows:
        want = (sets[2 * x.i] - sets[2 * x.i + 1], sets[2 * x.i + 1] - sets[2 * x.i])
        assert x.v.peeled and (set(x.v.only_a), set(x.v.only_b)) == want
        if x.f.peeled:
            assert (set(x.f.only_a), set(x.f.only_b)) == want
        else:
            assert x.f.only_a is None and sum(map(len, want)) > 1  # one difference always peels
            told += 1
    assert 0 < told < len(rows) / 2
    odd = spark.createDataFrame([(None, marks[0]), ("no fingerprint", marks[0]), (marks[0][:-8], marks[0])], "a string, b string")
    assert not any(r.f.peeled for r in odd.select(fingerprint_difference(F.col("a"), F.col("b")).alias("f")).collect())
