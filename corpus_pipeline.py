"""The corpus pipeline: quality -> near duplicates -> secrets -> mixing -> token ids.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder
and reads them back as the next one's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm.byte_bpe import bpe_digests
from facetspark.llm.jaccard_join import jaccard_components, set_digests
from facetspark.llm.mixing import training_order
from facetspark.llm.quality import quality_scores
from facetspark.llm.secret_scan import redacted, secret_scan
from facetspark.llm.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go.

    Every row is judged by its own text: rows without an id, rows that share one and repeated rows
    too. Null and empty texts are scored as such. Very long texts are read whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality_scores(docs, labels, carry=docs.columns).where("predicted = 1")
    return kept.select(*(F.col("carried")[c].alias(c) for c in docs.columns))


def _first_of_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of ``by``: the least in its other columns, so that reruns agree."""
    rest = [c for c in rows.columns if c not in by]
    least = rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("least"))
    return least.select(*(F.col(c) if c in by else F.col("least")[c].alias(c) for c in rows.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows with one id and text, the first by their other columns.

    Rows without an id go if their group has an id; of a group that no id names, one stays, and of empty texts each once.
    """
    joined = jaccard_components(docs, marks=True)
    kept = stored(joined.where("component_id = doc_id").select(F.col("doc_id").alias("kept_id")).distinct(), "kept-ids")
    named = docs.join(kept.hint("shuffle_merge"), docs["doc_id"] == kept["kept_id"], "left_semi")
    named = _first_of_each(named, ["doc_id", "text"])
    unnamed = stored(_first_of_each(docs.where("doc_id IS NULL"), ["text"]), "unnamed")
    if unnamed.isEmpty():
        return named
    leads = joined.where("doc_id IS NULL AND leads").select("digest").distinct()
    sets = set_digests(unnamed)
    one = sets.join(leads.hint("shuffle_merge"), "digest").groupBy("digest").agg(F.min("text").alias("kept_text")).select("kept_text")
    one = one.union(sets.where("n = 0").select("text"))
    return named.unionByName(unnamed.join(one.hint("shuffle_merge"), unnamed["text"].eqNullSafe(one["kept_text"]), "left_semi"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark, and n_chars counted again; all documents stay, null and empty texts as they are."""
    found = secret_scan(docs, carry=tuple(docs.columns))
    clean = F.size("spans") == 0
    text = F.when(clean, F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    out = found.select("carried", text.alias("text"), clean.alias("clean")).withColumn("n", F.when(
        F.col("clean"), F.col("carried.n_chars")).otherwise(F.char_length("text").cast("long")))
    new = {"text": F.col("text"), "n_chars": F.col("n")}
    return out.select(*(new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at their training positions: each as often as the mix uses it, range-sorted by position.

    Null and empty texts have no words to take and go. Rows without an id, or that share one, are documents like others.
    """
    return training_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document left, and of their decoding; null and empty texts have no ids."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

# Quality scores, the Jaccard groups' consequences and token ids are not SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
