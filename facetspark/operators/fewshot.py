"""Few-shot prompt building: neighbour examples, prompt templates, and a local vote."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.text import to_json_text

# Our own wording; the shape (intro, examples slot, instruction, input slot) follows the reference.
DEFAULT_TEMPLATE = (
    "You label e-commerce products. Read the product record and answer with its labels.\n"
    "Answer with one JSON object and nothing else.\n\n"
    "Labelled examples of similar products:\n\n"
    "{learning_input}\n\n"
    "Now label this product.\n"
    "input: {test_input}"
)
EXAMPLE_SEP = "\n\n"


def example_text(inputs: Sequence[str], labels: Sequence[str]) -> Column:
    """One example block: ``input: {json}\\noutput: {json}``."""
    return F.concat(F.lit("input: "), to_json_text(*inputs), F.lit("\noutput: "), to_json_text(*labels))


def join_neighbours(neighbours: DataFrame, train: DataFrame, id_col: str = "id") -> DataFrame:
    """``(qid, rank, nid)`` x train rows on the neighbour id (semi-join of the reference's
    ``id in [...]`` lookup, done once for all queries instead of once per query)."""
    t = train.withColumnRenamed(id_col, "nid")
    return neighbours.join(t, "nid", "inner")


def fewshot_examples(neighbours: DataFrame, train: DataFrame, inputs: Sequence[str],
                     labels: Sequence[str], id_col: str = "id", order: str = "similarity",
                     sep: str = EXAMPLE_SEP) -> DataFrame:
    """Concatenate each query's example blocks -> ``(qid, learning_input, n_examples)``.

    ``order='similarity'`` uses neighbour rank; ``order='train'`` uses the train
    id order (what the reference's table filter returns). A train row that is
    repeated gives as many examples, as a table filter would; ``n_examples``
    counts them all.
    """
    ex = join_neighbours(neighbours, train.select(id_col, *inputs, *labels), id_col)
    key = F.col("rank") if order == "similarity" else F.col("nid")
    ex = ex.select("qid", F.struct(key.alias("k"), F.col("nid"), example_text(inputs, labels).alias("text"))
                   .alias("e"))
    return ex.groupBy("qid").agg(
        F.array_join(F.sort_array(F.collect_list("e"))["text"], sep).alias("learning_input"),
        F.count(F.lit(1)).alias("n_examples"))


def with_examples(queries: DataFrame, examples: DataFrame, id_col: str = "id") -> DataFrame:
    """Every query row with its examples; one without neighbours gets ``''`` and 0."""
    out = queries.join(examples.withColumnRenamed("qid", id_col), id_col, "left")
    return out.fillna({"learning_input": "", "n_examples": 0})


def fill_prompt(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` slots with columns, Python ``str.format`` semantics for the literal text.

    The template is split into literals once on the driver; slot text inside
    the data is never re-expanded (nested ``replace`` would do that).
    """
    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise KeyError(f"template slot {field!r} has no column")
            parts.append(slots[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def knn_vote(neighbours: DataFrame, labelled: DataFrame, id_col: str = "id",
             label_col: str = "label") -> DataFrame:
    """Majority label of each query's neighbours -> ``(qid, predicted, votes)``; ties -> smaller label."""
    lab = labelled.select(F.col(id_col).alias("nid"), F.col(label_col).alias("_lab"))
    counts = neighbours.join(lab, "nid").groupBy("qid", "_lab").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("qid").orderBy(F.col("votes").desc(), F.col("_lab").asc())
    return (counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("qid", F.col("_lab").alias("predicted"), "votes"))


def vote_share(neighbours: DataFrame, labelled: DataFrame, truth: DataFrame, id_col: str = "id",
               label_col: str = "label") -> DataFrame:
    """Share of each query's neighbours carrying the query's own label -> ``(qid, p_true)``."""
    lab = labelled.select(F.col(id_col).alias("nid"), F.col(label_col).alias("_nlab"))
    tru = truth.select(F.col(id_col).alias("qid"), F.col(label_col).alias("_qlab"))
    j = neighbours.join(lab, "nid").join(tru, "qid")
    return j.groupBy("qid").agg(
        (F.sum((F.col("_nlab") == F.col("_qlab")).cast("double")) / F.count(F.lit(1))).alias("p_true"))
