"""Quality classifier: kernel ridge on document statistics by random Fourier features, calibrated isotonically.

1. Every text gives a row of statistics, computed in one Arrow pass and stored.
2. The statistics are standardised and mapped to ``features`` random cosines, whose
   inner products approximate a Gaussian kernel.
3. Every partition of the training rows adds up its part of the normal equations;
   Spark sums the cells, and the ridge weights are solved from the sum.
4. Ridge scores of held-back training rows, summed in bins, are pooled into a
   non-decreasing map to probabilities.

Only the training rows are bounded (``train_rows``, chosen by a hash of the id);
statistics and scores cover every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .hashing import row_slices, text_buffer, window_hashes, word_hashes
from .storage import stored

STATS = ("log_bytes", "word_length", "word_spread", "long_words", "letters", "upper", "digits", "marks", "spaces", "wide",
         "new_words", "new_grams", "top_word", "new_lines_share", "line_words", "first_capital", "stops", "marked_words",
         "bar_words", "mark_kinds")
FIT_PARTS = 16  # the training rows are bounded; each part sends one matrix
_UPPER, _LOWER_CASE, _DIGIT, _SPACE = (np.isin(np.arange(256), list(x)) for x in (
    range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32)))
_WIDE = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER_CASE | _DIGIT | _SPACE | _WIDE)


def statistics(col: pa.Array) -> np.ndarray:
    """One row of STATS per text; null and empty texts give zeros. Works through a few MB of text at a time."""
    buf, offs = text_buffer(col)
    parts = [_statistics(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]) for a, b in row_slices(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATS)))


def _statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offs) - 1, len(STATS)))
    words, rows = word_hashes(buf, offs, fold=True)
    grams = window_hashes(words, 3, 0x5851F42D4C957F2D)
    for i in range(len(out)):
        a, b, p, q = int(offs[i]), int(offs[i + 1]), int(rows[i]), int(rows[i + 1])
        if b == a:
            continue
        n = np.bincount(buf[a:b], minlength=256)
        size, count = b - a, max(1, q - p)
        upper, lower, marks = n[_UPPER].sum(), n[_LOWER_CASE].sum(), n[_MARK].sum()
        data = buf[a:b].tobytes()
        parts = data.split()
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) if parts else np.zeros(1, np.int64)
        lines = data.split(b"\n")
        each = np.unique(words[p:q], return_counts=True)[1]
        top = each.max() if q > p else 0
        tri = grams[p:q - 2] if q - p > 2 else words[p:q]
        # a mark after a letter or mark, not closing a clause: decoration rather than punctuation
        doubled = len(_DOUBLED.findall(data))
        out[i] = (
            np.log1p(size), lengths.mean(), lengths.std(), (lengths > 12).mean(), (upper + lower + n[_WIDE].sum()) / size,
            upper / max(1, upper + lower), n[_DIGIT].sum() / size, marks / size, n[_SPACE].sum() / size, n[_WIDE].sum() / size,
            len(each) / count, len(np.unique(tri)) / max(1, len(tri)), top / count,
            len(set(lines)) / len(lines), np.log1p(count / len(lines)),
            float(_UPPER[buf[a]]), (n[46] + n[33] + n[63]) / count, doubled / count, n[124] / count, (n[_MARK] > 0).sum() / 32)
    return out


_DOUBLED = re.compile(rb"[!#$%&*|~=<>^_@+]{1,}(?=\s|$)")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.freq + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.ridge(stats), self.knots, self.values), 0, 1).round(6)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, stats, crc`` of every row, stored; crc is the crc32 of the id as text (null: of '')."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "stats"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, f"id {kind}, stats array<double>")
    return stored(rows.withColumn("crc", _crc(F.col("id"))), "statistics")


def _crc(i: Column) -> Column:
    return F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary"))


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing fit of y by x (ascending), as knots and values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = np.array([k for b in blocks for k in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    values = np.array([b[0] / b[1] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))])
    return knots, values


def fit_quality(train: DataFrame, features: int = 192, width: float = 4.0, ridge: float = 1e-2, train_rows: int = 40000, bins: int = 400) -> QualityModel:
    """Fit on ``train(id, stats, label)``: about ``train_rows`` rows at most, by a hash of the id; a fifth of them calibrate.

    Without rows of both labels every score is the share of label 1 (0.5 without rows).
    """
    train = stored(train, "labelled")
    share = min(1.0, train_rows / max(1, train.count()))
    order = F.xxhash64("id", F.lit(11))
    bounded = train.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else train
    bounded = bounded.select("stats", "label", (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(5)) == 0).alias("held")).coalesce(FIT_PARTS)
    d = len(STATS)
    rng = np.random.default_rng(7)
    sums = bounded.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.sum(F.col("held").cast("int")).alias("held"), *(
        f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n, ones = sums.n, sums.ones or 0
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([sums[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    model = QualityModel(mean, scale, rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + d + 1), np.zeros(0), np.zeros(0), ones / n if n else 0.5)
    if not 0 < ones < n:
        return model
    size = features + d + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = model.cosines(np.stack(batch["stats"].to_numpy()))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ batch["label"].to_numpy(float)
        yield pd.DataFrame({"row": np.repeat(np.arange(size), size + 1), "col": np.tile(np.arange(size + 1), size), "part": total.ravel()})

    fit = bounded.where("NOT held") if 0 < (sums.held or 0) < n else bounded
    cells = fit.mapInPandas(equations, "row int, col int, part double").groupBy("row", "col").agg(F.sum("part").alias("part")).toPandas()
    full = np.zeros((size, size + 1))
    full[cells["row"], cells["col"]] = cells["part"]
    model.weights = np.linalg.solve(full[:, :size] + ridge * np.eye(size), full[:, size])

    def ridge_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"score": model.ridge(np.stack(batch["stats"].to_numpy())), "label": batch["label"]})

    held = bounded.where("held") if 0 < (sums.held or 0) < n else bounded
    binned = held.mapInPandas(ridge_scores, "score double, label double").withColumn(
        "bin", F.floor(F.least(F.greatest((F.col("score") + 0.5) / 2, F.lit(0.0)), F.lit(1.0)) * bins))
    binned = binned.groupBy("bin").agg(F.avg("score").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").toPandas()
    # one case of each label at the ends keeps scores off 0 and 1 and the ends apart
    x = np.concatenate([[binned["x"].min() - 0.05], binned["x"], [binned["x"].max() + 0.05]])
    model.knots, model.values = pool(x, np.concatenate([[0.0], binned["y"], [1.0]]), np.concatenate([[1.0], binned["w"], [1.0]]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", train_on: Column | None = None, carry: Sequence[str] = (), **fit) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``score`` in [0, 1], ``predicted`` (1 if score >= threshold).

    ``train_on`` is a condition on column ``crc``, the crc32 of the id as text; by
    default its remainder by 5 must not be 0, and ``held_out`` is the opposite. Labels
    other than 0 and 1 and null ids are not learned from; several labels of one id
    count by their mean. Null and empty texts are scored from zero statistics.
    Repeated rows get equal scores; extra columns, labels or sources are not read, but
    the columns that ``carry`` names (the text among them) come out as the struct ``carried``.
    Every row is judged by its own text, whatever its id. Statistics of very long texts are
    taken a few MB at a time. Sums are of doubles in no fixed order: reruns may differ in the
    last digits of a score.
    """
    train_on = (F.col("crc") % 5 != 0) if train_on is None else train_on
    stats = document_statistics(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    model = fit_quality(stats.where(train_on).join(known, "id").select("id", "stats", "label"), **fit)
    if carry:
        out = _scored_rows(docs, model, id_col, text_col, carry)
    else:
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat = batch.flatten().to_numpy(zero_copy_only=False)
                yield pa.array(model.score(flat.reshape(-1, len(STATS))))

        out = stats.withColumn("score", F.arrow_udf(score, "double")(F.col("stats")))
    return out.select(F.col("id").alias(id_col), (~train_on).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                      *(["carried"] if carry else []))


def _scored_rows(docs: DataFrame, model: QualityModel, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """``id, carried, score, crc``: the rows themselves scored in one pass, their statistics taken again rather than the texts stored or joined."""
    if text_col not in carry:
        raise ValueError(f"the carried columns must include {text_col}")
    place = list(carry).index(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    held = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the text is a field of what is carried: it crosses to Python once
            scores = model.score(statistics(batch.column(1).field(place)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=held.names)

    return rows.mapInArrow(score, held).withColumn("crc", _crc(F.col("id")))
