"""Token sequences: word vocabulary, ids, truncation, padding and attention masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.indexing import zip_index
from facetspark.session import store

WORD_SPLIT = r"[ \t\n\r]+"


def words(text: Column | str) -> Column:
    """Whitespace split, empty pieces dropped (whole text)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(t, WORD_SPLIT), "")


def word_vocab(df: DataFrame, text_col: str, start: int = 1) -> DataFrame:
    """Distinct words of every text, in byte order -> ``(word, n, wid)``; ids from ``start`` (0 = pad).

    ``n`` is how often the word occurs. Words are counted with a partial
    aggregate (a very common word costs one row per task), and ids come from a
    distributed positional index, not a single-partition rank.
    """
    counted = df.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # stored once: the token-id joins read it, and ids stay fixed after a lost executor
    return store(zip_index(counted, ["word"], "wid", start=start).select("word", "n", "wid"), "vocab")


def token_ids(df: DataFrame, id_col: str, text_cols: str | Sequence[str], vocab: DataFrame, max_length: int | Sequence[int],
              keep: Sequence[str] = (), hot_words: int = 10_000) -> DataFrame:
    """One row per input row: ``id``, the ``keep`` columns and for each text ``n_<text>`` and ``ids_<text>``.

    With a single text the columns are ``n_tokens`` and ``ids``. ``ids`` are the
    first ``max_length`` word ids in text order, ``n`` counts the whole text;
    truncation to ``max_length`` is the operator's purpose. Texts are split
    once; equal input rows stay separate rows (each has a key of its own), and a
    group holds at most the sum of the ``max_length`` entries.

    The ``hot_words`` most frequent words (a bounded table) are looked up by
    broadcast, the rest, where the vocabulary has more, by a shuffle join in which the words
    already found are dealt by row, so no common word is one reducer's key.
    """
    single = isinstance(text_cols, str)
    cols, most = ([text_cols], [max_length]) if single else (list(text_cols), list(max_length))
    w = df.select(id_col, *keep, F.monotonically_increasing_id().alias("_row"), *(words(F.col(c)).alias(f"_w{i}") for i, c in enumerate(cols)))
    sizes = [F.coalesce(F.size(f"_w{i}"), F.lit(0)).cast("bigint").alias(f"_n{i}") for i in range(len(cols))]
    heads = [F.transform(F.slice(f"_w{i}", 1, n), _place(i)) for i, n in enumerate(most)]
    heads = [F.coalesce(h, F.array().cast("array<struct<t:int,p:int,word:string>>")) for h in heads]
    head = w.select(id_col, *keep, "_row", *sizes, F.explode_outer(F.concat(*heads)).alias("e")).select(
        id_col, *keep, "_row", *(f"_n{i}" for i in range(len(cols))), "e.t", "e.p", "e.word")
    hot = vocab.orderBy(F.col("n").desc(), "wid").limit(hot_words).select("word", F.col("wid").alias("_hot"))
    ided = head.join(F.broadcast(hot), "word", "left")
    if vocab.limit(hot_words + 1).count() > hot_words:
        # a found (or absent) word gets a key that is no word: words hold no spaces
        found = F.col("_hot").isNotNull() | F.col("word").isNull()
        ided = ided.withColumn("_key", F.when(found, F.concat(F.lit(" "), F.col("_row").cast("string"))).otherwise(F.col("word")))
        rest = vocab.select(F.col("word").alias("_key"), "wid")
        ided = ided.join(rest, "_key", "left").withColumn("wid", F.coalesce("_hot", "wid"))
    else:
        ided = ided.withColumnRenamed("_hot", "wid")
    lists = [F.sort_array(F.collect_list(F.when(F.col("t") == i, F.struct("p", "wid"))))["wid"].alias("ids" if single else f"ids_{c}")
             for i, c in enumerate(cols)]
    names = ["n_tokens"] if single else [f"n_{c}" for c in cols]
    out = ided.groupBy("_row").agg(*(F.first(c).alias(c) for c in (id_col, *keep)), *(F.first(f"_n{i}").alias(n) for i, n in enumerate(names)), *lists)
    return out.drop("_row")


def _place(i: int):
    return lambda word, p: F.struct(F.lit(i).alias("t"), p.alias("p"), word.alias("word"))


def pad_truncate(ids: Column | str, length: int, pad: int = 0) -> tuple[Column, Column]:
    """Fixed-length ids and the matching attention mask (1 = real token)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(a, 1, length)
    fill = F.greatest(F.lit(length) - F.size(cut), F.lit(0))
    padded = F.concat(cut, F.array_repeat(F.lit(pad).cast("bigint"), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), fill))
    return padded, mask
