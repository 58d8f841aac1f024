"""Language ID by multilingual mixture inference.

Character n-gram likelihoods are learned per language. A document's n-grams are seen
as drawn from a mixture of languages: expectation-maximisation estimates the
proportions, and languages enter the set one by one as long as the likelihood gains
more than a penalty that grows with the logarithm of the document's length. The
language of the largest proportion is the prediction.

The model is a bounded table (``buckets`` x languages); it is learned from about
``docs_per_language`` documents of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix

BUCKETS, N, MAX_LANGUAGES = 1 << 16, 3, 256
UNKNOWN = "und"
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Buckets of the character n-grams: lower-cased letters, any run of other characters is one space."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[cp]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c = np.where(letter, cp, 32)[keep].astype(np.uint64)
    if len(c) < N or not letter.any():
        return np.zeros(0, np.int64)
    h = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    return (mix(h) >> np.uint64(64 - 16)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # buckets x languages
    penalty: float = 4.0

    def proportions(self, text: str | None) -> dict[str, float]:
        """The selected languages with their proportions; {} without a letter or without a model."""
        g = grams(text) if text else np.zeros(0, np.int64)
        if not len(g) or not self.languages:
            return {}
        weight = None
        n = len(g)
        if n > 4096:
            g, weight = np.unique(g, return_counts=True)
        p = self.likelihood[g].astype(np.float64)
        single = self._log(p).sum(axis=0) if weight is None else weight @ self._log(p)
        chosen = [int(np.argmax(single))]
        best, mixture = single[chosen[0]], np.ones(1)
        if len(self.languages) > 1:
            share, _ = _em(p, weight, n)
            for lang in np.argsort(-share, kind="stable").tolist():
                if lang in chosen:
                    continue
                pi, value = _em(p[:, [*chosen, lang]], weight, n)
                if value - best <= self.penalty * np.log(n):
                    break
                chosen, best, mixture = [*chosen, lang], value, pi
        return {self.languages[i]: float(x) for i, x in zip(chosen, mixture, strict=True)}

    @staticmethod
    def _log(p: np.ndarray) -> np.ndarray:
        return np.log(p)


def _em(p: np.ndarray, weight: np.ndarray | None, n: int, rounds: int = 30, close: float = 2e-3) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and their log-likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        each = 1 / (p @ pi)
        new = pi * ((each if weight is None else each * weight) @ p) / n
        done = np.abs(new - pi).max() < close
        pi = new
        if done:
            break
    log = np.log(p @ pi)
    return pi, float(log.sum() if weight is None else log @ weight)


def fit_languages(train: DataFrame, docs_per_language: int = 2000, smooth: float = 0.2, penalty: float = 4.0) -> LanguageModel:
    """Fit on ``train(id, text, lang)``; null languages and texts teach nothing. More than MAX_LANGUAGES languages raise."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = train.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not be a bounded table")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), penalty)
    share = {r["lang"]: int(min(1.0, docs_per_language / r["count"]) * (1 << 20)) for r in counts}
    limit = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(v))))
    sample = train.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(grams(text.as_py()), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])

    cells = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    n[cells["gram"].to_numpy(), [place[x] for x in cells["lang"].to_pylist()]] = cells["n"].to_numpy()
    p = (n + smooth) / (n.sum(axis=0) + smooth * BUCKETS)
    return LanguageModel(languages, p.astype(np.float32), penalty)


def language_mixtures(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score``, ``mixture``.

    ``mixture`` lists the selected languages with their proportions, largest first
    (equal ones by name), the first is ``lang_pred`` and its proportion ``score``.
    Null texts and texts without a letter, and all texts if no language was learned,
    give 'und', 0 and an empty list. Repeated rows give repeated rows; extra columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    out_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [sorted(((k, round(v, 6)) for k, v in m.proportions(t.as_py()).items()), key=lambda x: (-x[1], x[0])) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0][0] if f else UNKNOWN for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                pa.array([[{"lang": k, "share": v} for k, v in f] for f in found], out_type)], names=["id", "lang_pred", "score", "mixture"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        infer, f"id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>").withColumnRenamed("id", id_col)


def id_crc(id_col: str) -> Column:
    """crc32 of an id as text; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
