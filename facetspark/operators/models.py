"""Models as data work: a linear head on stored embeddings, a majority-label
predictor, and batched text generation behind a plug-in interface."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# ---------------------------------------------------------------- linear head


MAX_COEFFICIENTS = 20_000_000  # classes x features: held by the driver and sent to executors each iteration


def fit_linear_head(df: DataFrame, features: str, label: str, max_iter: int = 50, reg: float = 0.0, standardize: bool = True):
    """Softmax linear layer with cross-entropy on frozen vectors = multinomial logistic
    regression (distributed L-BFGS: one tree-aggregate per iteration).

    The coefficients are on the driver and broadcast each iteration; more than
    ``MAX_COEFFICIENTS`` of them raise (:mod:`facetspark.operators.sharded_softmax`
    fits such an attribute). ``reg`` penalises the weights of standardised features, or
    of the features as they are without ``standardize``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = df.select(array_to_vector(F.col(features)).alias("features"),
                      F.col(label).cast("double").alias("label"))
    size = df.agg((F.max(label) + 1).alias("classes"), F.max(F.size(features)).alias("dims")).first()
    if (size["classes"] or 0) * (size["dims"] or 0) > MAX_COEFFICIENTS:
        raise ValueError(f"{size['classes']} classes x {size['dims']} features are too many for one head")
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=standardize,
                            featuresCol="features", labelCol="label")
    return lr.fit(train)


def score_linear_head(model, df: DataFrame, features: str, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring -> ``(id, prediction, probability array)`` and the columns of ``keep``; argmax ties go to the lower class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(F.col(id_col), *keep, array_to_vector(F.col(features)).alias("features"))
    scored = model.transform(x).select(id_col, *keep, vector_to_array("rawPrediction").alias("raw"),
                                       vector_to_array("probability").alias("probability"))
    return scored.select(id_col, argmax(F.col("raw")).alias("prediction"), "probability", *keep)


def argmax(scores: Column) -> Column:
    """0-based index of the largest score (first one on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def fit_per_attribute(df: DataFrame, features: str, attrs: Sequence[str], parallelism: int = 4, **kw) -> dict:
    """One head per attribute (a short, fixed attribute list; each fit is a distributed job).

    The fits are independent, so up to ``parallelism`` of them run at once from
    driver threads (as MLlib's ``CrossValidator(parallelism=...)`` does); each
    one still trains on the whole table. Rows whose label is NULL are left out
    of that attribute's fit.
    """
    from concurrent.futures import ThreadPoolExecutor

    def fit(a: str):
        return a, fit_linear_head(df.filter(F.col(a).isNotNull()), features, a, **kw)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return dict(pool.map(fit, attrs))


# ---------------------------------------------------------------- majority predictor


def majority_label(train: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Most frequent label per ``(key, attr)`` -> ``(key, attr, predicted)``; ties -> smaller label.

    Counting is a partial aggregate, so a key holding a third of the rows
    costs one row per task; the window then sees distinct labels only.
    """
    long = train.select(F.col(key), *[F.col(a).cast("string").alias(a) for a in attrs]) \
                .unpivot([key], list(attrs), "attr", "label").filter(F.col("label").isNotNull())
    counts = long.groupBy(key, "attr", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key, "attr").orderBy(F.col("n").desc(), F.col("label").asc())
    return (counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(key, "attr", F.col("label").alias("predicted")))


# ---------------------------------------------------------------- plug-in generation

Generator = Callable[[pd.Series], pd.Series]
_REGISTRY: dict[str, Callable[[], Generator]] = {}


def register_generator(name: str):
    """Register a factory; it runs once per Python worker, not once per row."""
    def deco(factory: Callable[[], Generator]):
        _REGISTRY[name] = factory
        return factory
    return deco


# Loaded generators, per Python worker process. Spark reuses Python workers
# across tasks (spark.python.worker.reuse), so a registered model is built once
# per worker, not once per task or batch.
_LOADED: dict[str, Generator] = {}


def get_generator(name: str) -> Generator:
    if name not in _LOADED:
        _LOADED[name] = _REGISTRY[name]()
    return _LOADED[name]


def generate(df: DataFrame, text_col: str, generator: str | Callable[[], Generator],
             out_col: str = "generated", batch_rows: int | None = None) -> DataFrame:
    """Run a text generator over Arrow batches (``mapInPandas``).

    ``generator`` is a registered name (built once per Python worker and reused
    by later tasks) or a factory callable (built once per task). Batches are
    sized by ``spark.sql.execution.arrow.maxRecordsPerBatch`` (or ``batch_rows``).
    """
    if not callable(generator) and generator not in _REGISTRY:
        raise KeyError(f"unknown generator {generator!r}")
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = generator() if callable(generator) else get_generator(generator)
        for pdf in batches:
            if batch_rows:
                for s in range(0, len(pdf), batch_rows):
                    part = pdf.iloc[s:s + batch_rows].copy()
                    part[out_col] = gen(part[text_col]).astype(object).values
                    yield part
            else:
                pdf[out_col] = gen(pdf[text_col]).astype(object).values
                yield pdf

    return df.mapInPandas(run, schema)


def head_text_generator(heads: Sequence[tuple[str, object, Sequence[str]]], dims: int) -> Callable[[], Generator]:
    """A generator trained here: fitted linear heads on hashed words answer with a target text.

    ``heads`` holds (attribute, model of :func:`fit_linear_head`, labels by class number), fitted on
    :func:`facetspark.operators.retrieval.text_vector` of ``dims`` buckets. A text is hashed the
    same way, every head picks its label (first of equals), and the answer reads ``name: label`` in the
    heads' order. A null text has no answer. The weights travel with the task (heads are bounded).
    """
    weights = [(a, m.coefficientMatrix.toArray(), m.interceptVector.toArray(), list(labels)) for a, m, labels in heads]

    def factory() -> Generator:
        def vectors(texts: pd.Series) -> np.ndarray:
            x = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):
                for w in (t or "").lower().split(" "):
                    if w:
                        x[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims] += 1
            return x

        def answer(texts: pd.Series) -> pd.Series:
            x = vectors(texts)
            parts = []
            for a, w, bias, labels in weights:
                parts.append([f"{a}: {labels[k]}" for k in (x @ w.T + bias).argmax(axis=1)])
            return pd.Series([None if t is None else " ".join(p) for t, p in zip(texts, zip(*parts, strict=True), strict=True)], dtype=object)

        return answer

    return factory


def prompt_vote(render: Callable[[dict[str, str]], str]) -> Callable[[], Generator]:
    """A generator that answers with the majority of the labelled examples in its prompt.

    Example answers are the ``output: {...}`` lines that :mod:`fewshot` writes; per
    field the commonest value wins, ties go to the smaller text. A prompt
    without a readable example gets a NULL answer. This is the neighbour vote
    (M5) in the place of a language model, and what the queries run by default.
    """
    def factory() -> Generator:
        def answer(prompt: str | None) -> str | None:
            votes: dict[str, Counter] = {}
            for line in _EXAMPLE.findall(prompt or ""):
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                for k, v in found.items():
                    if v is not None:
                        votes.setdefault(k, Counter())[str(v)] += 1
            if not votes:
                return None
            return render({k: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for k, c in votes.items()})

        return lambda s: s.map(answer)

    return factory


_EXAMPLE = re.compile(r"^output: (\{.*\})$", re.M)


@register_generator("vote_text")
def _vote_text() -> Generator:
    """The vote as a seq2seq target text: ``name: value`` pairs."""
    return prompt_vote(lambda r: " ".join(f"{k}: {v}" for k, v in r.items()))()


@register_generator("vote_json")
def _vote_json() -> Generator:
    """The vote as a JSON object."""
    return prompt_vote(lambda r: json.dumps(r, ensure_ascii=False))()


@register_generator("vote_reply")
def _vote_reply() -> Generator:
    """The vote as a reply body: ``{"result": "\\n<json>"}``."""
    return prompt_vote(lambda r: json.dumps({"result": "\n" + json.dumps(r, ensure_ascii=False)}, ensure_ascii=False))()
