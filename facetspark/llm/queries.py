"""The dealt operators as registered queries: production parameters, whole tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has DuckDB
SQL for those SQL can express. The others are held against brute force, exact
round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .byte_bpe import bpe_digests
from .fingerprints import document_fingerprints
from .hard_negatives import mine_hard_negatives
from .jaccard_join import jaccard_components
from .langid import fit_languages, id_crc, language_mixtures
from .mixing import curriculum_mix
from .quality import quality_scores
from .secret_scan import BASE_RULES, RULES, secret_scan, span_text
from .shard_shuffle import shuffled_shards
from .substring_dedup import substring_dedup
from .url_filter import url_filter
from .whitening import whitened_components

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go; digest of what is kept."""
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS seq
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT seq FROM win GROUP BY seq HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS p FROM win JOIN rep USING (seq)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text by the 50k byte-level ranks, decoded again; digests of both."""
    import public_tokenizers

    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts of the base kinds, digest of their spans, all spans."""
    found = secret_scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(span_text(F.filter("spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def _secret_sql() -> str:
    spans = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        spans.append(f"""SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, m[i] AS hit, c[i] AS checked, {r.least} AS least,
        list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m,
       regexp_extract_all(text, '{p}', {r.group}) AS c, regexp_split_to_array(text, '{p}') AS s FROM documents))""")
    kinds = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    one = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT)"
    return f"""
WITH span AS ({' UNION ALL '.join(spans)}),
held AS (SELECT doc_id, {kinds}, string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
         string_agg({one}, ',' ORDER BY start, rank) AS spans FROM span WHERE length(checked) >= least GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN held USING (doc_id)
"""


ORACLES["op9_secret_scan"] = _secret_sql()


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum over all documents, in training order."""
    return curriculum_mix(_table(spark, sf_dir, "documents")).drop("positions", "key")


ORACLES["op10_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      CASE nth % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l),
a AS (SELECT d.*, source_size, target, slope, floor(target + 0.5) AS stop,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN size > 0 AND before + size / 2 < stop THEN least((before + size / 2) / target, 1.0) END AS u FROM a)
SELECT doc_id, size, source_size, target,
       CAST(least(greatest(stop - before, 0), size) + least(greatest(stop - source_size - before, 0), size) + least(greatest(stop - 2 * source_size - before, 0), size) AS BIGINT) AS taken,
       CASE WHEN slope = 0 THEN u ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4 * slope * u) - (1.0 - slope)) / (2 * slope) END AS position
FROM p
"""


@_query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by mixture inference learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held = id_crc("doc_id") % 4 == 2
    model = fit_languages(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = language_mixtures(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every whole text, learned from the labels that are not held out."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible sketches of every text and its edited version, and how alike they and neighbours are."""
    return document_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter(_table(spark, sf_dir, "pages"))


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, by one small-world graph per shard."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 32 strongest axes of their covariance, whitened."""
    return whitened_components(_table(spark, sf_dir, "embeddings"), components=32)


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 negatives within 50 to 95 % of each of the 5 positives of every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
      CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""


@_query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, uniformly shuffled into 16 shards of equal row counts; digest of what arrives."""
    placed = shuffled_shards(_table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return placed.select(F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
