"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

A url that a rule fits takes the verdict of the longest such rule. The others are
judged by a logistic regression on hashed character n-grams of host and path, trained
on a small labelled table of urls: by default the distinct (host, path) pairs that
the rules themselves judge, at most ``train_urls`` of them by hash order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

MAX_RULES = 2000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): from after the first ``://`` to / ? # or the end, A-Z lower-cased; then to ? # or the end."""
    whole = F.coalesce(F.when(F.contains(url, F.lit("://")), url), F.lit(""))
    rest = F.substring(whole, F.instr(whole, "://") + 3, F.char_length(whole))
    rest = F.when(F.contains(whole, F.lit("://")), rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_verdict(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, ties to the earlier one; nulls if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join a rule table instead of one expression")
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Marked character n-grams of ``<text>``; as many as the text is long, for each size. Linear in its length."""
    letters = F.regexp_extract_all(F.concat(F.lit("<"), text, F.lit(">")), F.lit("(?s)."), F.lit(0))

    def of(c: Column, size: int) -> Column:
        grams = F.transform(c, lambda x, i: F.concat(F.lit(f"{mark}{size}:"), x, *(F.get(c, i + k) for k in range(1, size))))
        return F.filter(grams, lambda g: g.isNotNull())  # the last few have no further letters

    # split once, then by place: taking each from the text would walk it again
    return F.transform(F.array(letters), lambda c: F.concat(*(of(c, s) for s in sizes)))[0]


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", train_urls: int = 20000, buckets: int = 1 << 15, sizes: tuple[int, ...] = (3, 4), rounds: int = 30) -> DataFrame:
    """One row per input row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``rule`` is the longest fitting rule's text or null; ``verdict`` is the rule's,
    else block if ``score``, the modelled probability of block, is 0.5 or more, else
    allow. A null url or one without ``://`` has empty host and path and is judged by
    the model. With labels of one verdict only the score is 0 or 1 by that verdict;
    without labels it is 0. ``labelled(host, path, verdict)`` replaces the rules as
    the training table; null fields and other verdicts teach nothing. Repeated rows
    give repeated rows; extra columns are not read.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", rule_verdict(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "by.rule", "by.verdict")
    known = rows if labelled is None else labelled
    known = known.select("host", "path", "verdict").where("verdict IN ('allow', 'block') AND host IS NOT NULL AND path IS NOT NULL").distinct()
    known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    known = stored(known.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(train_urls).select("host", "path", "label"), "labelled-urls")
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}

    tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True)
    grams = F.concat(_grams(F.col("host"), "h", sizes), _grams(F.col("path"), "p", sizes))
    if len(count) == 2:
        whole = sum(count.values())
        weight = F.when(F.col("label") == 1, whole / (2 * count[1.0])).otherwise(whole / (2 * count[0.0]))
        train = tf.transform(known.withColumn("grams", grams).withColumn("weight", weight)).select("features", "label", "weight")
        model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=rounds, standardization=False).fit(train.persist())
        train.unpersist()
        # a host and path is judged once, however many pages have it
        judged = model.transform(tf.transform(rows.where("rule IS NULL").select("host", "path").distinct().withColumn("grams", grams)))
        judged = judged.select("host", "path", F.round(vector_to_array("probability")[1], 6).alias("score"))
        rows = rows.join(judged, ["host", "path"], "left")
    else:
        rows = rows.withColumn("score", F.lit(float(1.0 in count)))
    score = F.coalesce("score", (F.col("verdict") == "block").cast("double"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
