"""Registered queries: each is a Spark plan over the test tables plus the DuckDB
SQL that computes the same rows (column names aligned), used as its oracle.

Every query reads whole tables. Where a case the tables lack is needed (a
missing retailer, an ``na`` label, a malformed line), it is derived from the
data by a value rule applied to every row, identically in Spark and SQL; no
rows are filtered away to make a check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facetspark.functions.text import (classifier_text, cut_marker, extraction_pattern, last_word, num_text,
                                       render_fields, to_json_text)
from facetspark.operators import epochs as EP
from facetspark.operators import extract as X
from facetspark.operators import fewshot as FS
from facetspark.operators import instructions as INS
from facetspark.operators.layout import spread
from facetspark.operators import lsh as LSH
from facetspark.operators import merge as MG
from facetspark.operators import metrics as MT
from facetspark.operators import models as MD
from facetspark.operators import pairing as PR
from facetspark.operators import retrieval as RT
from facetspark.operators import sampling as SM
from facetspark.operators import sharded_softmax as SS
from facetspark.operators import tokens as TK
from facetspark.operators import vocab as VC
from facetspark.plans.catalog import (ATTRS, ATTRS_P1, INPUTS, INPUTS_P1, ITEMS_P1_SQL, ITEMS_SQL, items,
                                      items_phase1, stored_items, table)
from facetspark.sources import records as RC

# the test tables are single files of one row group: deal them out before heavy per-row work
_SPREAD = 16

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _with_items(body: str) -> str:
    return "WITH " + ITEMS_SQL.strip() + ",\n" + body.strip()


def _sql_pat(attrs) -> str:
    """The extraction pattern for RE2 (DuckDB): ``^`` anchor, no Java flags."""
    return "^" + extraction_pattern(attrs)[len("(?d)^"):]


def _sql_extract(text: str, attrs) -> str:
    pat = _sql_pat(attrs)
    return ",\n".join(
        f"CASE WHEN regexp_matches({text}, '{pat}') THEN regexp_extract({text}, '{pat}', {i + 1}) "
        f"ELSE 'na' END AS \"{a}\"" for i, a in enumerate(attrs))


def _sql_fields(pairs, null_text="'None'") -> str:
    return " || ' ' || ".join(f"'{n}: ' || coalesce({e}, {null_text})" for n, e in pairs)


_TARGET_SQL = _sql_fields([(a, f'"{a}"') for a in ATTRS])


def _target(df: DataFrame) -> F.Column:
    return render_fields([(a, F.col(a)) for a in ATTRS])


# ------------------------------------------------------------------ extraction (flagship)

@query("extract_attributes", _with_items(f"""
t AS (SELECT id, CASE WHEN retailer IS NULL THEN 'note: no retailer. ' ELSE '' END || {_TARGET_SQL} AS txt
      FROM items)
SELECT id, {_sql_extract('txt', ATTRS)} FROM t"""))
def q_extract_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text (phase-2 labels) -> anchored regex extraction -> record with fixed key order.
    Texts of items without a retailer carry a leading note, so they miss the anchor -> ``na``."""
    it = items(spark, sf_dir)
    txt = F.concat(F.when(F.col("retailer").isNull(), F.lit("note: no retailer. ")).otherwise(F.lit("")),
                   _target(it))
    return X.extract_attributes(it.select("id", txt.alias("txt")), "txt", ATTRS)


@query("cut_marker", _with_items(f"""
SELECT id, split_part({_TARGET_SQL} || ' brand: ' || coalesce(brand, 'None'), ' brand', 1) AS cut FROM items"""))
def q_cut_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation that repeats its last field, cut at the first marker."""
    it = items(spark, sf_dir)
    txt = F.concat(_target(it), F.lit(" brand: "), F.coalesce(F.col("brand"), F.lit("None")))
    return it.select("id", cut_marker(txt, " brand").alias("cut"))


_TARGET_P1_SQL = _sql_fields([(a, a) for a in ATTRS_P1])
_INPUT_P1_SQL = _sql_fields([(a, a) for a in INPUTS_P1])


@query("extract_phase1", f"""
WITH {ITEMS_P1_SQL.strip()},
t AS (SELECT id, {_INPUT_P1_SQL} AS input_text,
             CASE WHEN store IS NULL THEN 'note: no store. ' ELSE '' END || {_TARGET_P1_SQL} AS txt FROM items1)
SELECT id, input_text, {_sql_extract('txt', ATTRS_P1)} FROM t""")
def q_extract_phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-1 schema: ``title/store/details_Manufacturer`` input text and the six-label
    target (brand + five category levels) -> six-group anchored extraction."""
    it = items_phase1(spark, sf_dir)
    inp = render_fields([(a, F.col(a)) for a in INPUTS_P1])
    txt = F.concat(F.when(F.col("store").isNull(), F.lit("note: no store. ")).otherwise(F.lit("")),
                   render_fields([(a, F.col(a)) for a in ATTRS_P1]))
    return X.extract_attributes(it.select("id", inp.alias("input_text"), txt.alias("txt")), "txt", ATTRS_P1,
                                keep=["input_text"])


# ------------------------------------------------------------------ sources / parsing

_LINE_RULES = """
CASE p_partkey % 7
 WHEN 0 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "description": "' || p_name || '", "brand": "' || p_brand
             || '", "type": "' || p_type || '", "price": ' || CAST(p_retailprice AS VARCHAR) || '}'
 WHEN 1 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "description": "' || p_name
             || '", "brand": "", "type": null, "price": null}'
 WHEN 2 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "description": "' || p_name || '", "price": -'
             || CAST(p_retailprice AS VARCHAR) || ', "x": 1e5, "size": ' || CAST(p_size AS VARCHAR) || '}'
 WHEN 3 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "description": "' || CAST(p_size AS VARCHAR)
             || '\\" ' || p_name || '", "brand": "' || p_brand || '"}'
 WHEN 4 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "brand": "' || p_brand || '", "brand": "' || p_type
             || '", "price": ' || CAST(CAST(round(p_retailprice * 100000) AS BIGINT) AS VARCHAR) || '}'
 WHEN 5 THEN '{"indoml_id": "p' || CAST(p_partkey AS VARCHAR) || '", "description": "' || p_name || '"}'
 ELSE '  {"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ',  "description":  "two spaces", "tags": ["' || p_type
             || '"], "n": {"k": "' || p_brand || '"}}  '
END"""


def _lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw record lines rendered from ``part``, one malformation family per ``p_partkey % 7``; one has an id that is no integer."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                                    "p_retailprice"), _SPREAD)
    pk = F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("string")
    size = F.col("p_size").cast("string")
    head = F.concat(F.lit('{"indoml_id": '), pk)
    v = F.pmod(F.col("p_partkey"), F.lit(7))
    line = (F.when(v == 0, F.concat(head, F.lit(', "description": "'), F.col("p_name"), F.lit('", "brand": "'),
                                    F.col("p_brand"), F.lit('", "type": "'), F.col("p_type"), F.lit('", "price": '),
                                    price, F.lit("}")))
            .when(v == 1, F.concat(head, F.lit(', "description": "'), F.col("p_name"),
                                   F.lit('", "brand": "", "type": null, "price": null}')))
            .when(v == 2, F.concat(head, F.lit(', "description": "'), F.col("p_name"), F.lit('", "price": -'), price,
                                   F.lit(', "x": 1e5, "size": '), size, F.lit("}")))
            .when(v == 3, F.concat(head, F.lit(', "description": "'), size, F.lit('\\" '), F.col("p_name"),
                                   F.lit('", "brand": "'), F.col("p_brand"), F.lit('"}')))
            .when(v == 4, F.concat(head, F.lit(', "brand": "'), F.col("p_brand"), F.lit('", "brand": "'),
                                   F.col("p_type"), F.lit('", "price": '),
                                   F.round(F.col("p_retailprice") * 100000).cast("bigint").cast("string"), F.lit("}")))
            .when(v == 5, F.concat(F.lit('{"indoml_id": "p'), pk, F.lit('", "description": "'), F.col("p_name"), F.lit('"}')))
            .otherwise(F.concat(F.lit("  "), head, F.lit(',  "description":  "two spaces", "tags": ["'),
                                F.col("p_type"), F.lit('"], "n": {"k": "'), F.col("p_brand"), F.lit('"}}  '))))
    return p.select(line.alias("value"))


_PARSE_KEYS = ("description", "brand", "type", "price", "x", "size", "k")
_PAT_SQL = RC.LENIENT_PATTERN


def _sql_key(key: str) -> str:
    i = f"(CASE WHEN list_contains(ks, '{key}') THEN len(ks) + 1 - list_position(list_reverse(ks), '{key}') END)"
    return (f"CASE WHEN {i} IS NULL THEN NULL WHEN coalesce(ns[{i}], '') <> '' "
            f"THEN CAST(CAST(ns[{i}] AS DOUBLE) AS VARCHAR) ELSE trim(ts[{i}]) END AS \"{key}\"")


@query("parse_lenient", f"""
WITH l AS (SELECT {_LINE_RULES} AS line FROM part),
s AS (SELECT regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[{{}}]+|[{{}}]+$', '', 'g') AS s FROM l),
m AS (SELECT regexp_extract_all(s, '{_PAT_SQL}', 1) AS ks, regexp_extract_all(s, '{_PAT_SQL}', 2) AS ns,
             regexp_extract_all(s, '{_PAT_SQL}', 3) AS ts FROM s)
SELECT TRY_CAST(ns[len(ks) + 1 - list_position(list_reverse(ks), 'indoml_id')] AS BIGINT) AS id,
       {", ".join(_sql_key(k) for k in _PARSE_KEYS)},
       CAST(len(list_distinct(ks)) AS BIGINT) AS n_keys,
       coalesce(ns[len(ks) + 1 - list_position(list_reverse(ks), 'indoml_id')], '') = '' AS rejected
FROM m""")
def q_parse_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw record lines (seven malformation families rendered from ``part``) -> lenient key/value map
    -> projected keys; lines whose id isn't an integer come from the reject frame."""
    good, rejects = RC.parse_records(_lenient_lines(spark, sf_dir))
    both = good.withColumn("rejected", F.lit(False)).unionByName(rejects.drop("value").withColumn("rejected", F.lit(True)))
    return both.select("id", *[F.col("fields")[k].alias(k) for k in _PARSE_KEYS],
                       F.size("fields").cast("bigint").alias("n_keys"), "rejected")


@query("parse_strict", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON text (``events.props``) -> typed field through ``from_json``; malformed text is NULL."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", RC.json_fields(F.col("props"), "k bigint")["k"].alias("k"))


@query("num_text", """
SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price_text,
       CAST(o_totalprice * 100 AS VARCHAR) AS cents_text,
       CAST(o_totalprice / 1e7 AS VARCHAR) AS scaled_text
FROM orders""")
def q_num_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices, x100 and /1e7, rendered the way Python prints a float (plain and exponent forms)."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), _SPREAD)
    return o.select("o_orderkey", num_text(F.col("o_totalprice")).alias("price_text"),
                    num_text(F.col("o_totalprice") * 100).alias("cents_text"),
                    num_text(F.col("o_totalprice") / F.lit(1e7)).alias("scaled_text"))


_STRICT_LINES = """
SELECT CASE p_partkey % 5
  WHEN 0 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "brand": "' || p_brand || '", "size": ' || CAST(p_size AS VARCHAR) || '}'
  WHEN 1 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "brand": null}'
  WHEN 2 THEN '{"indoml_id": ' || CAST(p_partkey AS VARCHAR) || ', "size": "x' || CAST(p_size AS VARCHAR) || '"}'
  WHEN 3 THEN '{"brand": "' || p_brand || '"}'
  ELSE 'no json ' || p_brand END AS value FROM part"""


@query("parse_strict_rejects", f"""
WITH l AS ({_STRICT_LINES.strip()}),
j AS (SELECT value, CASE WHEN json_valid(value) THEN value END AS v FROM l),
f AS (SELECT value, TRY_CAST(json_extract_string(v, '$.indoml_id') AS BIGINT) AS id, json_extract_string(v, '$.brand') AS brand,
             TRY_CAST(json_extract_string(v, '$.size') AS BIGINT) AS size,
             v IS NULL OR (json_extract_string(v, '$.size') IS NOT NULL AND TRY_CAST(json_extract_string(v, '$.size') AS BIGINT) IS NULL) AS corrupt FROM j)
SELECT id, brand, size, corrupt OR id IS NULL AS rejected, CASE WHEN corrupt THEN value END AS corrupt FROM f""")
def q_parse_strict_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON lines rendered from ``part``: good records, and the rejects (wrong type, no id, no
    JSON) with the text of those that could not be read."""
    p = table(spark, sf_dir, "part")
    pk, brand, size = F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_size").cast("string")
    head = F.concat(F.lit('{"indoml_id": '), pk)
    v = F.pmod(F.col("p_partkey"), F.lit(5))
    line = (F.when(v == 0, F.concat(head, F.lit(', "brand": "'), brand, F.lit('", "size": '), size, F.lit("}")))
            .when(v == 1, F.concat(head, F.lit(', "brand": null}')))
            .when(v == 2, F.concat(head, F.lit(', "size": "x'), size, F.lit('"}')))
            .when(v == 3, F.concat(F.lit('{"brand": "'), brand, F.lit('"}')))
            .otherwise(F.concat(F.lit("no json "), brand)))
    good, rejects = RC.parse_records(p.select(line.alias("value")), mode="strict", schema="indoml_id bigint, brand string, size bigint")
    good = good.withColumn("rejected", F.lit(False)).withColumn("corrupt", F.lit(None).cast("string"))
    rejects = rejects.withColumn("rejected", F.lit(True)).withColumn("corrupt", F.col(RC.CORRUPT))
    cols = ["id", "brand", "size", "rejected", "corrupt"]
    return good.select(*cols).unionByName(rejects.select(*cols))


# ------------------------------------------------------------------ text rendering

@query("classifier_text", _with_items("""
SELECT id,
  'Product Name: ' || coalesce(description, 'None') || ', Sold by retailer: ' || coalesce(retailer, 'None')
    || ', Price: ' || coalesce(CAST(price AS VARCHAR), 'None') AS input,
  concat_ws('', 'Product Name: ' || description, ', Sold by retailer: ' || retailer,
            ', Price: ' || CAST(price AS VARCHAR)) AS input_skip_nulls
FROM items"""))
def q_classifier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's input text, with ``None`` for a missing value (parity) and with the clause
    of a missing value left out."""
    it = items(spark, sf_dir)
    return it.select("id", classifier_text("description", "retailer", "price").alias("input"),
                     classifier_text("description", "retailer", "price", null_text=None).alias("input_skip_nulls"))


_INPUT_SQL = _sql_fields([("description", "d.description"), ("retailer", "d.retailer"),
                          ("price", "CAST(d.price AS VARCHAR)")])


def _input_text() -> F.Column:
    return render_fields([("description", F.col("description")), ("retailer", F.col("retailer")),
                          ("price", num_text(F.col("price")))])


@query("seq2seq_pairs", _with_items(f"""
SELECT d.id, {_INPUT_SQL} AS input_text,
       {_sql_fields([(a, f's."{a}"') for a in ATTRS])} AS target_text
FROM (SELECT id, description, retailer, price FROM items WHERE split <> 'test') d
JOIN (SELECT id, supergroup, "group", module, brand FROM items) s ON d.id = s.id"""))
def q_seq2seq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data x solution on the id (train and val items) -> phase-2 input text and target text."""
    it = items(spark, sf_dir)
    return PR.seq2seq_pairs(it.filter(F.col("split") != "test"), it, INPUTS, ATTRS, "id")


@query("prefer_data", """
SELECT p_partkey AS id, p_size AS size, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE 'own ' || p_type END AS brand
FROM part""")
def q_prefer_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and label rows that both have a brand: the data side wins where its record has the key, even with
    an explicit null (every third part), and the label fills in where the key is absent (another third)."""
    p = table(spark, sf_dir, "part")
    v = F.pmod(F.col("p_partkey"), F.lit(3))
    line = (F.when(v == 0, F.lit('{"brand": null}')).when(v == 1, F.lit("{}"))
            .otherwise(F.concat(F.lit('{"brand": "own '), F.col("p_type"), F.lit('"}'))))
    data = p.select(F.col("p_partkey").alias("id"), F.from_json(line, "map<string,string>").alias("fields"))
    data = data.withColumn("brand", F.col("fields")["brand"])
    labels = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return PR.pair_by_id(data, labels, fields="fields").select("id", "size", "brand")


@query("positional_zip", """
WITH u AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos
           FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos
      FROM conversations WHERE role = 'assistant')
SELECT u.pos, u.conv_id AS user_conv_id, u.turn AS user_turn, u.text AS user_text,
       a.conv_id AS assistant_conv_id, a.turn AS assistant_turn, a.text AS assistant_text
FROM u JOIN a ON u.pos = a.pos""")
def q_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th user turn paired with the i-th assistant turn, both in (conversation, turn) order."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select(F.col("conv_id").alias("user_conv_id"),
                                                  F.col("turn").alias("user_turn"), F.col("text").alias("user_text"))
    a = c.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("assistant_conv_id"),
                                                       F.col("turn").alias("assistant_turn"),
                                                       F.col("text").alias("assistant_text"))
    return PR.pair_by_position(u, a, ["user_conv_id", "user_turn"], ["assistant_conv_id", "assistant_turn"])


@query("instruction_records", f"""
WITH r AS (
  SELECT u.conv_id, u.turn, '{INS.INSTRUCTION}' AS instruction, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, instruction, input, output,
       '{INS.PROMPT_PREFIX}' || to_json({{'instruction': instruction, 'input': input}}) AS prompt
FROM r""")
def q_instruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it -> instruction record + prompt text."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("a_text"))
    pairs = u.join(a, ["conv_id", "turn"])
    rec = INS.instruction_records(pairs, "u_text", "a_text")
    return INS.instruction_prompts(rec, "instruction", "input").select(
        "conv_id", "turn", "instruction", "input", "output", "prompt")


@query("instruction_lines", f"""
WITH r AS (
  SELECT u.conv_id, u.turn, regexp_replace(u.text, '[\r\n]', ' ', 'g') AS f,
         regexp_replace(a.text, '[\r\n]', ' ', 'g') AS l
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, '{INS.INSTRUCTION}' AS instruction,
       f AS input, l AS output
FROM r""")
def q_instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records from two line-aligned files: user turns (``features``) and the
    following assistant turns (``labels``) are written one record per line in
    (conversation, turn) order, read back as plain lines, numbered, and zipped by position
    (strict: the files must have equally many lines)."""
    from facetspark.session import scratch_path
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("a"))
    pairs = u.join(a, ["conv_id", "turn"])
    one_line = lambda col: F.regexp_replace(F.col(col), r"[\r\n]", " ")
    base = scratch_path(spark, "instruction_lines")
    ordered = pairs.orderBy("conv_id", "turn")  # range-partitioned: part files in key order
    ordered.select(one_line("u").alias("value")).write.text(f"{base}/features")
    ordered.select(one_line("a").alias("value")).write.text(f"{base}/labels")
    feats = RC.read_numbered_lines(spark, f"{base}/features", "pos").withColumnRenamed("value", "f")
    labs = RC.read_numbered_lines(spark, f"{base}/labels", "pos").withColumnRenamed("value", "l")
    zipped = PR.pair_numbered(feats, labs, strict=True)
    rec = INS.instruction_records(zipped, "f", "l")
    return rec.select("pos", "instruction", "input", "output")


# ------------------------------------------------------------------ vocabularies

def _labels_sql(where: str, source: str = "items") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS attr, CAST(\"{a}\" AS VARCHAR) AS label FROM {source} WHERE {where}" for a in ATTRS)


@query("label_vocab", _with_items(f"""
l AS ({_labels_sql("split = 'train'")})
SELECT attr, label, dense_rank() OVER (PARTITION BY attr ORDER BY label) - 1 AS idx
FROM (SELECT DISTINCT attr, label FROM l WHERE label IS NOT NULL)"""))
def q_label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, sorted index of every train label per attribute (distributed, no single-task window)."""
    it = items(spark, sf_dir).filter(F.col("split") == "train")
    return VC.build_vocab(it, ATTRS).select("attr", "label", "idx")


@query("label_cardinality", _with_items(f"""
l AS ({_labels_sql("split = 'train'")})
SELECT attr, count(DISTINCT label) AS n_labels FROM l GROUP BY attr"""))
def q_label_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct train labels per attribute."""
    it = items(spark, sf_dir).filter(F.col("split") == "train")
    return VC.label_cardinality(it, ATTRS)


def _with_na(df: DataFrame) -> DataFrame:
    """Items without a retailer get the ``na`` module label."""
    return df.withColumn("module", F.when(F.col("retailer").isNull(), F.lit("na")).otherwise(F.col("module")))


@query("cardinality_sketches", _with_items(f"""
l AS ({_labels_sql("true")}
      UNION ALL SELECT 'word', unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) FROM documents),
n AS (SELECT attr, count(DISTINCT label) AS n_labels FROM l WHERE label IS NOT NULL GROUP BY attr)
SELECT attr, n_labels, true AS within_error FROM n"""))
def q_cardinality_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels of every attribute (and distinct words of all documents) from one stored sketch per split (per
    language), merged: the exact count, and whether the estimate is within three standard errors of it."""
    from facetspark.session import store
    it = stored_items(spark, sf_dir, "split", *ATTRS)
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"), _SPREAD)
    words = docs.select("lang", F.explode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("word"))
    sketches = store(VC.label_sketches(it, ATTRS, by=["split"]).drop("split").unionByName(
        VC.label_sketches(words, ["word"], by=["lang"]).drop("lang")), "sketches")
    exact = VC.label_cardinality(it, ATTRS).unionByName(VC.label_cardinality(words, ["word"]))
    off = F.abs(F.col("n_estimated") - F.col("n_labels"))
    return exact.join(VC.merged_cardinality(sketches), "attr").select(
        "attr", "n_labels", (off <= F.greatest(F.lit(1.0), VC.sketch_error() * F.col("n_labels"))).alias("within_error"))


@query("vocab_without_na", _with_items(f"""
n AS (SELECT id, split, supergroup, "group", brand,
             CASE WHEN retailer IS NULL THEN 'na' ELSE module END AS module FROM items),
l AS ({_labels_sql("split = 'train'", "n")})
SELECT attr, label, dense_rank() OVER (PARTITION BY attr ORDER BY label) - 1 AS idx
FROM (SELECT DISTINCT attr, label FROM l WHERE label IS NOT NULL AND label <> 'na')"""))
def q_vocab_without_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train vocabulary with the ``na`` label removed and the indexes above it shifted down."""
    it = _with_na(items(spark, sf_dir)).filter(F.col("split") == "train")
    return VC.compact_vocab(VC.build_vocab(it, ATTRS)).select("attr", "label", "idx")


@query("encode_labels", _with_items(f"""
v AS (SELECT attr, label, dense_rank() OVER (PARTITION BY attr ORDER BY label) - 1 AS idx
      FROM (SELECT DISTINCT attr, label FROM ({_labels_sql("split = 'val'")}) WHERE label IS NOT NULL)),
t AS ({" UNION ALL ".join(f"SELECT id, '{a}' AS attr, CAST(\"{a}\" AS VARCHAR) AS label FROM items WHERE split = 'train'" for a in ATTRS)})
SELECT t.id, t.attr, t.label, v.idx, coalesce(v.idx, 0) AS idx_zero
FROM t LEFT JOIN v ON t.attr = v.attr AND t.label = v.label"""))
def q_encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train labels -> indexes of the val vocabulary; unseen labels NULL (``idx``) or 0 (``idx_zero``)."""
    it = stored_items(spark, sf_dir, "id", "split", *ATTRS)
    vocab = VC.build_vocab(it.filter(F.col("split") == "val"), ATTRS)
    enc = VC.encode_labels(it.filter(F.col("split") == "train"), vocab, ATTRS)
    return enc.withColumn("idx_zero", F.coalesce(F.col("idx"), F.lit(0).cast("bigint")))


@query("decode_labels", _with_items(f"""
v AS (SELECT attr, label, dense_rank() OVER (PARTITION BY attr ORDER BY label) - 1 AS idx
      FROM (SELECT DISTINCT attr, label FROM ({_labels_sql("split = 'train'")}) WHERE label IS NOT NULL)),
t AS ({" UNION ALL ".join(f"SELECT id, '{a}' AS attr, CAST(\"{a}\" AS VARCHAR) AS label FROM items WHERE split = 'val'" for a in ATTRS)}),
e AS (SELECT t.id, t.attr, v.idx FROM t LEFT JOIN v ON t.attr = v.attr AND t.label = v.label)
SELECT e.id, e.attr, e.idx, v.label AS decoded FROM e LEFT JOIN v ON e.attr = v.attr AND e.idx = v.idx"""))
def q_decode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Val labels encoded with the train vocabulary and decoded back (NULL where unseen)."""
    it = stored_items(spark, sf_dir, "id", "split", *ATTRS)
    vocab = VC.build_vocab(it.filter(F.col("split") == "train"), ATTRS)
    enc = VC.encode_labels(it.filter(F.col("split") == "val"), vocab, ATTRS).select("id", "attr", "idx")
    return VC.decode_labels(enc, vocab, out_col="decoded").select("id", "attr", "idx", "decoded")


@query("split_counts", _with_items("""
SELECT split, count(*) AS n_items, count(retailer) AS n_with_retailer, count(DISTINCT brand) AS n_brands
FROM items GROUP BY split"""))
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, items with a retailer and distinct brands per split."""
    it = items(spark, sf_dir)
    return it.groupBy("split").agg(F.count(F.lit(1)).alias("n_items"), F.count("retailer").alias("n_with_retailer"),
                                   F.countDistinct("brand").alias("n_brands"))


_CLS_TEXT_SQL = ("'Product Name: ' || coalesce(description, 'None') || ', Sold by retailer: ' || "
                 "coalesce(retailer, 'None') || ', Price: ' || coalesce(CAST(price AS VARCHAR), 'None')")


@query("classifier_dataset", _with_items(f"""
n AS (SELECT *, CASE WHEN retailer IS NULL THEN 'na' ELSE module END AS module_na FROM items),
v AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS idx
      FROM (SELECT DISTINCT module_na AS label FROM n WHERE split = 'val' AND module_na IS NOT NULL
            AND module_na <> 'na'))
SELECT n.id, n.split, {_CLS_TEXT_SQL} AS input, coalesce(v.idx, 0) AS output
FROM n LEFT JOIN v ON v.label = n.module_na
WHERE n.split = 'test' OR n.module_na IS DISTINCT FROM 'na'"""))
def q_classifier_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's per-attribute dataset (``module``; items without a retailer are ``na``):
    vocabulary from the val labels, ``na`` removed and indexes compacted, written partitioned
    by attribute and read back for one attribute (partition pruning); ``na`` rows dropped on
    train/val only; unseen labels -> class 0, as the reference does."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = _with_na(stored_items(spark, sf_dir))
    vocab = VC.compact_vocab(VC.build_vocab(it.filter(F.col("split") == "val"), ["module"]))
    path = scratch_path(spark, "vocab")
    SK.write_partitioned(vocab.select("attr", "label", "idx"), path, ["attr"])
    stored = SK.read_vocab(spark, path, "module")
    # ``na`` rows leave train/val only; the test split keeps them
    rows = VC.drop_missing(it, "module", unless=F.col("split") == "test")
    enc = VC.map_labels(rows, stored, "module", "output", unknown="zero")
    return enc.select("id", "split", classifier_text("description", "retailer", "price").alias("input"), "output")


@query("file_layout", _with_items("""
SELECT id, split, description, retailer, price, supergroup, "group", module, brand
FROM items WHERE split <> 'test'"""))
def q_file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's file convention: data as JSON lines in ``attribute_<split>.data`` and
    solutions as JSON-array files in ``attribute_<split>.solution`` (one partition folder per
    file name, written only if absent: a second, different write is skipped); read back with the split taken from the file name,
    then data x solution on the id."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = stored_items(spark, sf_dir)
    base = scratch_path(spark, "file_layout")
    fname = F.concat(F.lit("attribute_"), F.col("split"))
    data = it.select(F.col("id").alias("indoml_id"), *INPUTS, F.concat(fname, F.lit(".data")).alias("file"))
    sol = it.filter(F.col("split") != "test").select(F.col("id").alias("indoml_id"), *ATTRS,
                                                     F.concat(fname, F.lit(".solution")).alias("file"))
    data.write.mode("ignore").partitionBy("file").json(f"{base}/data")
    SK.write_json_arrays(sol, f"{base}/solution", by=["file"], mode="ignore")
    # a second run finds both and must leave them as they are, whatever it would have written
    other = data.withColumn("description", F.lit("second run"))
    other.write.mode("ignore").partitionBy("file").json(f"{base}/data")
    SK.write_json_arrays(sol.withColumn("brand", F.lit("second run")), f"{base}/solution", by=["file"], mode="ignore")
    SK.write_if_absent(other, f"{base}/data", fmt="json")
    in_file = RC.split_from_file_name(F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+)/", 1))
    d = RC.read_jsonl(spark, f"{base}/data", "indoml_id bigint, description string, retailer string, price double") \
        .select(F.col("indoml_id").alias("id"), *INPUTS, in_file.alias("split"))
    a = RC.read_json_array(spark, f"{base}/solution",
                           "indoml_id bigint, supergroup string, `group` string, module string, brand string") \
        .select(F.col("indoml_id").alias("id"), *ATTRS, in_file.alias("_sol_split"))
    j = PR.pair_by_id(d, a, "id")
    return j.filter(F.concat(F.col("split"), F.lit("_sol")) == F.col("_sol_split")).select(
        "id", "split", *INPUTS, *ATTRS)


@query("json_array_splits", _with_items("""
SELECT id, split, supergroup, "group", module, brand FROM items"""))
def q_json_array_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records written as large pretty-printed JSON arrays, read back a file split per task: record boundaries
    by a prefix scan over the pieces between closing braces."""
    from facetspark.session import scratch_path
    from facetspark.sources import arrays as AR
    from facetspark.sources import sinks as SK
    base = scratch_path(spark, "json_array")
    it = items(spark, sf_dir).select(F.col("id").alias("indoml_id"), "split", *ATTRS)
    SK.write_json_arrays(it, base, max_bytes=1 << 30)
    schema = "indoml_id bigint, split string, " + ", ".join(f"`{a}` string" for a in ATTRS)
    return AR.read_json_array_splits(spark, base, schema).withColumnRenamed("indoml_id", "id")


@query("write_once", _with_items("""
SELECT id, split, brand, n.rows AS n_rows, true AS redone, true AS skipped FROM items, (SELECT count(*) AS rows FROM items) n"""))
def q_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written once: what a failed run left (rows without a manifest) is written again, a whole output is
    skipped by the next run, and readers get the rows that the manifest names."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = stored_items(spark, sf_dir, "id", "split", "brand")
    path = scratch_path(spark, "write_once")
    it.filter(F.col("split") == "val").write.parquet(f"{path}/attempt-failed")
    redone = SK.write_once(it, path, by=["split"])
    skipped = not SK.write_once(it.withColumn("brand", F.lit("second run")), path, by=["split"])
    rows = SK.read_manifest(spark, path)["rows"]
    return SK.read_once(spark, path).select("id", "split", "brand", F.lit(rows).cast("bigint").alias("n_rows"),
                                            F.lit(redone).alias("redone"), F.lit(skipped).alias("skipped"))


# ------------------------------------------------------------------ caps and samples

@query("row_cap", """
SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100""")
def q_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 100 documents by id (a deterministic row cap: per-task top-n, one small merge)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return SM.row_cap(d, 100, ["doc_id"])


@query("hash_sample", """
SELECT doc_id, lang, n_chars FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded hash sample of 100 documents (MD5 order, so SQL can check it)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return SM.hash_sample(d, 100, "doc_id", seed=42, method="md5")


@query("hash_shuffle", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
FROM documents""")
def q_hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded, reproducible shuffle of every document -> ``(doc_id, pos)``: the position of
    each document in the seeded order (distributed positional index, no single-task window)."""
    from facetspark.operators.indexing import zip_index
    d = table(spark, sf_dir, "documents").select("doc_id")
    keyed = d.withColumn("_h", SM.seeded_key("doc_id", 42, "md5"))
    return zip_index(keyed, ["_h", "doc_id"], "pos").select("doc_id", "pos")


# ------------------------------------------------------------------ tokens

_TOK_LEN = 64


@query("pad_truncate", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws
           FROM documents),
v AS (SELECT word, dense_rank() OVER (ORDER BY word) AS wid
      FROM (SELECT DISTINCT unnest(ws) AS word FROM w)),
h AS (SELECT doc_id, unnest(ws[1:{_TOK_LEN}]) AS word, generate_subscripts(ws[1:{_TOK_LEN}], 1) AS p FROM w),
ids AS (SELECT h.doc_id, list(v.wid ORDER BY h.p) AS ids FROM h JOIN v ON h.word = v.word GROUP BY h.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_tokens,
       array_to_string(list_concat(coalesce(ids.ids, []), list_transform(range({_TOK_LEN} - len(coalesce(ids.ids, []))), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(range(len(coalesce(ids.ids, []))), lambda x: 1),
                                   list_transform(range({_TOK_LEN} - len(coalesce(ids.ids, []))), lambda x: 0)), ',') AS attention_mask
FROM w LEFT JOIN ids ON w.doc_id = ids.doc_id""")
def q_pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vocabulary over every whole document -> first 64 ids per document, padded, with the
    attention mask; ``n_tokens`` counts the whole text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), _SPREAD)
    vocab = TK.word_vocab(docs, "text")
    ids = TK.token_ids(docs, "doc_id", "text", vocab, _TOK_LEN)
    padded, mask = TK.pad_truncate("ids", _TOK_LEN)
    return ids.select("doc_id", "n_tokens", F.array_join(padded, ",").alias("input_ids"),
                      F.array_join(mask, ",").alias("attention_mask"))


_S2S_IN, _S2S_OUT = 352, 128


def _ids_sql(words: str, n: int) -> str:
    """Comma-joined ids of the first ``n`` words, and their number."""
    return (f"SELECT w.id, count(v.wid) AS n, coalesce(string_agg(CAST(v.wid AS VARCHAR), ',' ORDER BY p), '') AS ids "
            f"FROM (SELECT id, unnest({words}[1:{n}]) AS word, generate_subscripts({words}[1:{n}], 1) AS p FROM w) h "
            f"JOIN v USING (word) RIGHT JOIN w ON w.id = h.id GROUP BY w.id")


@query("seq2seq_tokens", _with_items(f"""
p AS (SELECT id, split, {_INPUT_SQL.replace('d.', '')} AS input_text,
             {_sql_fields([(a, f'"{a}"') for a in ATTRS])} AS target_text FROM items WHERE split <> 'test'),
w AS (SELECT id, split, list_filter(regexp_split_to_array(input_text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS wi,
             list_filter(regexp_split_to_array(target_text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS wt FROM p),
v AS (SELECT word, dense_rank() OVER (ORDER BY word) AS wid
      FROM (SELECT DISTINCT unnest(wi) AS word FROM w UNION SELECT DISTINCT unnest(wt) FROM w)),
a AS ({_ids_sql('wi', _S2S_IN)}),
b AS ({_ids_sql('wt', _S2S_OUT)})
SELECT w.id, w.split, CAST(len(w.wi) AS BIGINT) AS n_input_tokens,
       a.ids || repeat(',0', CAST({_S2S_IN} - a.n AS INTEGER)) AS input_ids,
       substr(repeat(',1', CAST(a.n AS INTEGER)) || repeat(',0', CAST({_S2S_IN} - a.n AS INTEGER)), 2) AS attention_mask,
       b.ids || repeat(',0', CAST({_S2S_OUT} - b.n AS INTEGER)) AS labels
FROM w JOIN a USING (id) JOIN b USING (id)"""))
def q_seq2seq_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seq2seq training rows: one word vocabulary over input and target texts, input ids
    truncated/padded with an attention mask, target ids as the ``labels`` column; written by
    ``split`` and read back."""
    from facetspark.session import scratch_path, store
    from facetspark.sources import sinks as SK
    it = items(spark, sf_dir).filter(F.col("split") != "test")
    pairs = store(it.select("id", "split", _input_text().alias("input"), _target(it).alias("target")), "pairs")
    texts = pairs.select(F.explode(F.array("input", "target")).alias("t"))
    vocab = TK.word_vocab(texts, "t")
    rows = TK.token_ids(pairs, "id", ["input", "target"], vocab, [_S2S_IN, _S2S_OUT], keep=["split"])
    ids, mask = TK.pad_truncate("ids_input", _S2S_IN)
    lab, _ = TK.pad_truncate("ids_target", _S2S_OUT)
    rows = rows.select("id", "split", F.col("n_input").alias("n_input_tokens"), ids.alias("input_ids"), mask.alias("attention_mask"), lab.alias("labels"))
    path = scratch_path(spark, "tokens")
    SK.write_partitioned(rows, path, ["split"])
    return spark.read.parquet(path).select("id", "split", "n_input_tokens", *(
        F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "labels")))


# ------------------------------------------------------------------ retrieval and few-shot

_K = 5
_EMB_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_TOPK_SQL = f"""
topk AS (
  SELECT qid, rnk AS rank, nid, score FROM (
    SELECT a.vec_id AS qid, b.vec_id AS nid, {_EMB_DOT} AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY {_EMB_DOT} DESC, b.vec_id) AS rnk
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rnk <= {_K})"""


def _topk(spark: SparkSession, sf_dir: str, sides: RT.Sides | None = None) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return RT.topk_neighbours(emb, emb, _K, id_col="vec_id", vec_col="embedding", exclude_self=True, sides=sides)


@query("topk_neighbours", f"""
WITH {_TOPK_SQL.strip()}
SELECT qid, CAST(rank AS BIGINT) AS rank, nid, round(score, 6) AS score FROM topk""")
def q_topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out exact top-5 by dot product over every embedding, in blocks of bounded size."""
    return _topk(spark, sf_dir).withColumn("score", F.round("score", 6))


_CELLS = 8


@query("topk_cells", ORACLES["topk_neighbours"])
def q_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists through the cell index with every cell probed: exact, whatever the cells are."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centres = RT.fit_cells(emb, _CELLS)
    out = RT.cell_topk(emb, emb, centres, probes=_CELLS, k=_K, id_col="vec_id")
    return out.withColumn("score", F.round("score", 6))


# probed cells, and the recall to hold there: 6 is the operating point, 4 is reported beside it
_PROBES = ((4, 0.5), (6, 0.9), (_CELLS, 1.0))


@query("cell_recall", f"""
WITH {_TOPK_SQL.strip()}
SELECT p.probes, count(*) AS n_exact, true AS recall_ok FROM topk, (VALUES {", ".join(f"({p})" for p, _ in _PROBES)}) p(probes) GROUP BY p.probes""")
def q_cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the cell index at 4, 6 and all 8 probed cells: at least 0.9 at 6, the operating point, 1 with all
    of them, and at 4 not under the share of cells probed. ``neighbour_recall`` returns the figures."""
    return _recalls(spark, sf_dir, False).select("probes", "n_exact", "recall_ok")


def _recalls(spark: SparkSession, sf_dir: str, lsh: bool) -> DataFrame:
    from facetspark.session import store
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centres = RT.fit_cells(emb, _CELLS)
    sides = RT.vector_sides(emb, emb, _K, id_col="vec_id")
    exact = store(_topk(spark, sf_dir, sides).select("qid", "nid"), "exact")

    def one(found: DataFrame, method: str, probes: int, least: float) -> DataFrame:
        return RT.recall_at_k(found, exact).select(F.lit(method).alias("method"), F.lit(probes).alias("probes"), "n_exact", "n_found", "recall",
                                                   (F.col("recall") >= least).alias("recall_ok"))

    out, scored = None, RT.cell_scores(emb, emb, centres, _CELLS, _K, id_col="vec_id", sides=sides)
    for probes, least in _PROBES:
        r = one(RT.cell_topk(emb, emb, centres, probes=probes, k=_K, id_col="vec_id", scored=scored), "cells", probes, least)
        out = r if out is None else out.unionByName(r)
    if lsh:
        index = _lsh(emb, sides)
        out = out.unionByName(one(LSH.lsh_topk(emb, emb, index, _K, id_col="vec_id", sides=sides), f"lsh, {index.tables} tables", index.probes, 0.9))
    return out


def _lsh(emb: DataFrame, sides: RT.Sides | None = None) -> LSH.Lsh:
    """An index tuned to find 0.95 of the neighbours of 200 sampled queries."""
    return LSH.tune_tables(emb, emb, LSH.fit_lsh(emb, bits=8, tables=48, probes=8), _K, target=0.95, id_col="vec_id", sides=sides)


@query("lsh_topk")
def q_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top-5 of every embedding by the banded LSH join, scores exact (``lsh_recall`` holds it against the exact lists)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sides = RT.vector_sides(emb, emb, _K, id_col="vec_id")
    return LSH.lsh_topk(emb, emb, _lsh(emb, sides), _K, id_col="vec_id", sides=sides)


@query("lsh_recall", f"""
WITH {_TOPK_SQL.strip()}
SELECT count(*) AS n_exact, true AS recall_ok, true AS scores_ok FROM topk""")
def q_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LSH join against the exact lists: at least 0.9 of the neighbours found, and no found neighbour scored otherwise."""
    from facetspark.session import store
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sides = RT.vector_sides(emb, emb, _K, id_col="vec_id")
    found = LSH.lsh_topk(emb, emb, _lsh(emb, sides), _K, id_col="vec_id", sides=sides).select("qid", "nid", F.col("score").alias("s"))
    exact = store(_topk(spark, sf_dir, sides).select("qid", "nid", "score"), "exact")
    both = exact.join(found, ["qid", "nid"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("s") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"),
                    F.coalesce(F.max(F.abs(F.col("s") - F.col("score"))) <= 1e-9, F.lit(False)).alias("scores_ok"))


@query("neighbour_recall")
def q_neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured recall of the approximate searches: by cells at 4, 6 and all probed, and by the tuned LSH join."""
    return _recalls(spark, sf_dir, True).select("method", "probes", "n_exact", "n_found", "recall")


_VOTE_SQL = f"""
{_TOPK_SQL.strip()},
c AS (SELECT t.qid, e.label, count(*) AS votes FROM topk t JOIN embeddings e ON e.vec_id = t.nid
      GROUP BY t.qid, e.label),
vote AS (SELECT qid, label AS predicted, votes FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS r FROM c) WHERE r = 1),
pred AS (SELECT e.vec_id AS qid, e.label, v.predicted, v.votes FROM vote v JOIN embeddings e ON e.vec_id = v.qid)"""


def _vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    v = FS.knn_vote(_topk(spark, sf_dir), emb, id_col="vec_id", label_col="label")
    return v.join(emb.select(F.col("vec_id").alias("qid"), "label"), "qid")


@query("knn_vote", f"""
WITH {_VOTE_SQL.strip()}
SELECT qid, label, predicted, votes FROM pred""")
def q_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority label of each embedding's 5 nearest neighbours (ties -> smaller label)."""
    return _vote(spark, sf_dir).select("qid", "label", "predicted", "votes")


@query("macro_metrics", f"""
WITH {_VOTE_SQL.strip()},
lab AS (SELECT CAST(label AS VARCHAR) AS label, 1 AS t, 0 AS p, CAST(label = predicted AS INTEGER) AS tp FROM pred
        UNION ALL SELECT CAST(predicted AS VARCHAR), 0, 1, 0 FROM pred),
cc AS (SELECT label, sum(t) AS n_true, sum(p) AS n_pred, sum(tp) AS tp FROM lab GROUP BY label),
s AS (SELECT CASE WHEN n_pred = 0 THEN 1.0 ELSE tp / n_pred END AS pr,
             CASE WHEN n_true = 0 THEN 1.0 ELSE tp / n_true END AS rc,
             CASE WHEN n_true + n_pred = 0 THEN 1.0 ELSE 2.0 * tp / (n_true + n_pred) END AS f1 FROM cc)
SELECT (SELECT count(*) FROM pred) AS n,
       (SELECT round(avg(CAST(label = predicted AS DOUBLE)), 6) FROM pred) AS accuracy,
       round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f1), 6) AS f1
FROM s""")
def q_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro precision/recall/F1 (``zero_division=1``) of the kNN vote."""
    return MT.macro_metrics(_vote(spark, sf_dir), "label", "predicted")


@query("confusion_counts", f"""
WITH {_VOTE_SQL.strip()},
lab AS (SELECT CAST(label AS VARCHAR) AS label, 1 AS t, 0 AS p, CAST(label = predicted AS INTEGER) AS tp FROM pred
        UNION ALL SELECT CAST(predicted AS VARCHAR), 0, 1, 0 FROM pred)
SELECT label, CAST(sum(t) AS BIGINT) AS n_true, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp
FROM lab GROUP BY label""")
def q_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: true count, predicted count and true positives of the kNN vote."""
    return MT.confusion_counts(_vote(spark, sf_dir), "label", "predicted")


@query("cross_entropy", f"""
WITH {_TOPK_SQL.strip()},
sh AS (SELECT t.qid, sum(CAST(n.label = q.label AS DOUBLE)) / count(*) AS p_true
       FROM topk t JOIN embeddings n ON n.vec_id = t.nid JOIN embeddings q ON q.vec_id = t.qid GROUP BY t.qid)
SELECT count(*) AS n, round(avg(-ln(least(greatest(p_true, 1e-6), 1.0))), 6) AS cross_entropy FROM sh""")
def q_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-entropy of the neighbour vote share given to each embedding's own label."""
    emb = table(spark, sf_dir, "embeddings")
    share = FS.vote_share(_topk(spark, sf_dir), emb, emb, id_col="vec_id", label_col="label")
    return MT.cross_entropy(share, "p_true")


_DIMS = 32


def _vec_items(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Every item with a vector of its own (hashed words of the description), stored once.
    Without columns: all of them; ``lineitem`` is read only if the retailer is asked for."""
    from facetspark.session import store
    it = items(spark, sf_dir)
    it = it.withColumn("embedding", RT.text_vector(F.col("description"), _DIMS))
    return store(it.select("embedding", *cols) if cols else it, "vectors")


def _fewshot(spark: SparkSession, sf_dir: str, all_items: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query items with ``learning_input`` and ``n_examples``, train items): each query item's 5 most similar train
    items, itself left out. Every query item is there, with no examples if it has no neighbours."""
    it = _vec_items(spark, sf_dir)
    train = it.filter(F.col("split") == "train")
    asked = it if all_items else it.filter(F.col("split") == "test")
    nb = RT.topk_neighbours(asked, train, _K, id_col="id", vec_col="embedding", exclude_self=True)
    return FS.with_examples(asked, FS.fewshot_examples(nb, train, INPUTS, ATTRS, order="similarity")), train


_JSON_IN = "to_json({'description': %(p)sdescription, 'retailer': %(p)sretailer, 'price': %(p)sprice})"
_JSON_OUT = ("to_json({'supergroup': %(p)ssupergroup, 'group': %(p)s\"group\", 'module': %(p)smodule, "
             "'brand': %(p)sbrand})")


def _fewshot_sql(asked: str = "split = 'test'", order: str = "nb.rank") -> str:
    """ei: items with hashed-word vectors; nb: each asked item's nearest train items; ex: their example blocks."""
    return _with_items(f"""
ws AS (SELECT id, list_transform(list_filter(string_split(lower(coalesce(description, '')), ' '), lambda w: w <> ''),
                                 lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % {_DIMS}) AS spots FROM items),
ei AS (SELECT i.*, list_transform(range({_DIMS}), lambda b: len(list_filter(spots, lambda s: s = b))::DOUBLE) AS embedding
       FROM items i JOIN ws USING (id)),
nb AS (
  SELECT qid, rnk AS rank, nid FROM (
    SELECT a.id AS qid, b.id AS nid,
           row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.embedding, b.embedding) DESC, b.id) AS rnk
    FROM (SELECT * FROM ei WHERE {asked}) a JOIN (SELECT * FROM ei WHERE split = 'train') b ON a.id <> b.id)
  WHERE rnk <= {_K}),
ex AS (
  SELECT q.id AS qid, count(nb.nid) AS n_examples, coalesce(
         string_agg('input: ' || {_JSON_IN % {"p": "t."}} || chr(10) || 'output: ' || {_JSON_OUT % {"p": "t."}},
                    chr(10) || chr(10) ORDER BY {order}), '') AS learning_input
  FROM (SELECT * FROM ei WHERE {asked}) q LEFT JOIN nb ON nb.qid = q.id LEFT JOIN ei t ON t.id = nb.nid GROUP BY q.id),
votes AS (
  SELECT qid, attr, label, row_number() OVER (PARTITION BY qid, attr ORDER BY count(*) DESC, label) AS r
  FROM ({" UNION ALL ".join(f"SELECT qid, '{a}' AS attr, t.\"{a}\" AS label FROM nb JOIN ei t ON t.id = nb.nid" for a in ATTRS)})
  WHERE label IS NOT NULL GROUP BY qid, attr, label),
voted AS (SELECT q.id, {", ".join(f"max(label) FILTER (WHERE attr = '{a}') AS \"{a}\"" for a in ATTRS)}
          FROM (SELECT * FROM ei WHERE {asked}) q LEFT JOIN (SELECT * FROM votes WHERE r = 1) v ON v.qid = q.id GROUP BY q.id)""")


_FEWSHOT_SQL = _fewshot_sql()


@query("fewshot_examples", _FEWSHOT_SQL + "\nSELECT qid, n_examples, learning_input FROM ex")
def q_fewshot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every test item: its 5 most similar train items (exact top-k on hashed-word vectors)
    rendered as example blocks in similarity order."""
    asked, _ = _fewshot(spark, sf_dir)
    return asked.select(F.col("id").alias("qid"), "n_examples", "learning_input")


def _template_sql(template: str) -> str:
    import string
    parts = []
    for lit, field, _s, _c in string.Formatter().parse(template):
        if lit:
            parts.append("'" + lit.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if field == "learning_input":
            parts.append("ex.learning_input")
        elif field == "test_input":
            parts.append(_JSON_IN % {"p": "q."})
    return " || ".join(parts)


def _prompts(asked: DataFrame, template: str) -> DataFrame:
    prompt = FS.fill_prompt(template, {"learning_input": F.col("learning_input"), "test_input": to_json_text(*INPUTS)})
    return asked.select("id", prompt.alias("prompt"))


@query("fewshot_prompt", _FEWSHOT_SQL + f"""
SELECT ex.qid, {_template_sql(FS.DEFAULT_TEMPLATE)} AS prompt
FROM ex JOIN ei q ON q.id = ex.qid""")
def q_fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few-shot prompt per test item: template read from a file, examples and the item's record
    filled into its slots."""
    from facetspark.session import scratch_path
    asked, _ = _fewshot(spark, sf_dir)
    # the template is configuration: one small text file, read once on the driver
    path = scratch_path(spark, "prompt_template")
    spark.createDataFrame([(FS.DEFAULT_TEMPLATE,)], "value string").coalesce(1).write.text(path)
    return _prompts(asked, RC.read_template(spark, path)).withColumnRenamed("id", "qid")


@query("fewshot_stored", _fewshot_sql(order="nb.nid") + "\nSELECT qid, n_examples, learning_input FROM ex")
def q_fewshot_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists computed once, stored as ``(id, neighbour_ids)`` Parquet, read back,
    exploded and joined to the train rows (the reference's ``id in [...]`` lookup, once for all
    queries); examples in train-table (id) order, as the reference returns them."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = _vec_items(spark, sf_dir)
    test = it.filter(F.col("split") == "test")
    train = it.filter(F.col("split") == "train")
    nb = RT.topk_neighbours(test, train, _K, id_col="id", vec_col="embedding", exclude_self=False)
    path = scratch_path(spark, "neighbours")
    RT.neighbour_lists(nb).write.parquet(path)
    stored = SK.read_neighbours(spark, path, "id bigint, neighbour_ids array<bigint>")
    ex = FS.fewshot_examples(RT.explode_neighbours(stored), train, INPUTS, ATTRS, order="train")
    return FS.with_examples(test.select("id"), ex).select(F.col("id").alias("qid"), "n_examples", "learning_input")


@query("fewshot_predict", _FEWSHOT_SQL + """
SELECT id AS qid, supergroup, "group", module, brand FROM voted""")
def q_fewshot_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few-shot pipeline end to end: prompt -> reply (plug-in generator over Arrow batches; the
    default answers with the majority of the prompt's examples) -> reply clean-up and JSON
    parse -> record with the query id -> appended JSON lines, read back."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    asked, _ = _fewshot(spark, sf_dir)
    prompts = _prompts(asked, FS.DEFAULT_TEMPLATE).withColumnRenamed("id", "qid")
    replies = MD.generate(prompts, "prompt", "vote_reply", out_col="reply")
    parsed = X.parse_reply(replies, "reply", ", ".join(f"`{a}` string" for a in ATTRS), id_col="qid",
                           keep_clean=False)
    path = scratch_path(spark, "fewshot_predict")
    SK.append_jsonl(parsed, path)
    return RC.read_jsonl(spark, path, "qid bigint, " + ", ".join(f"`{a}` string" for a in ATTRS))


# ------------------------------------------------------------------ majority predictions, merge, accuracy

def _majority_sql(split: str, name: str) -> str:
    longs = " UNION ALL ".join(
        f"SELECT retailer, '{a}' AS attr, CAST(\"{a}\" AS VARCHAR) AS label FROM items WHERE split = '{split}'"
        for a in ATTRS)
    return f"""{name} AS (
  SELECT retailer, attr, label AS predicted FROM (
    SELECT retailer, attr, label, row_number() OVER (PARTITION BY retailer, attr ORDER BY n DESC, label) AS r
    FROM (SELECT retailer, attr, label, count(*) AS n FROM ({longs}) WHERE label IS NOT NULL
          GROUP BY retailer, attr, label)) WHERE r = 1)"""


@query("item_accuracy", _with_items(f"""
{_majority_sql('train', 'mj')},
v AS (SELECT * FROM items WHERE split = 'val'),
ok AS (SELECT v.id, {" AND ".join(f"coalesce(v.\"{a}\" = (SELECT predicted FROM mj WHERE mj.retailer = v.retailer AND mj.attr = '{a}'), false)" for a in ATTRS)} AS ok
       FROM v)
SELECT count(*) AS n, round(avg(CAST(ok AS DOUBLE)), 6) AS item_accuracy FROM ok"""))
def q_item_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Val items vs the per-retailer majority labels of the train split: all four right?"""
    it = stored_items(spark, sf_dir, "id", "split", "retailer", *ATTRS)
    mj = MD.majority_label(it.filter(F.col("split") == "train"), "retailer", ATTRS)
    wide = mj.groupBy("retailer").pivot("attr", list(ATTRS)).agg(F.first("predicted"))
    wide = wide.select("retailer", *[F.col(a).alias(f"p_{a}") for a in ATTRS])
    val = it.filter(F.col("split") == "val").join(wide, "retailer", "left")
    return MT.item_accuracy(val, [(a, f"p_{a}") for a in ATTRS])


_RUN0 = ("supergroup", "group")
_RUN1 = ("supergroup", "module", "brand")


@query("merge_attributes", _with_items(f"""
{_majority_sql('train', 'm0')},
{_majority_sql('val', 'm1')},
lg AS (
  SELECT i.id, m.attr, m.predicted AS value, 0 AS seq FROM items i JOIN m0 m ON m.retailer = i.retailer
   WHERE m.attr IN ({", ".join(f"'{a}'" for a in _RUN0)})
  UNION ALL
  SELECT i.id, m.attr, m.predicted AS value, 1 AS seq FROM items i JOIN m1 m ON m.retailer = i.retailer
   WHERE m.attr IN ({", ".join(f"'{a}'" for a in _RUN1)}))
SELECT id, {", ".join(f"arg_max(value, seq) FILTER (WHERE attr = '{a}') AS \"{a}\"" for a in ATTRS)}
FROM lg GROUP BY id"""))
def q_merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction sets (train-fitted for 2 attributes, val-fitted for 3) merged per id;
    the later set wins, attributes neither set predicts stay absent."""
    it = stored_items(spark, sf_dir)
    longs = []
    for seq, (split, attrs) in enumerate((("train", _RUN0), ("val", _RUN1))):
        mj = MD.majority_label(it.filter(F.col("split") == split), "retailer", attrs)
        pred = it.select("id", "retailer").join(mj, "retailer")
        longs.append(pred.select("id", "attr", F.col("predicted").alias("value"),
                                 F.lit(seq).cast("bigint").alias("seq")))
    return MG.merge_attributes(longs[0].unionByName(longs[1]), ATTRS)


@query("submission_files", f"""
SELECT row_number() OVER (ORDER BY id) - 1 AS pos, * FROM ({ORACLES["merge_attributes"]})""")
def q_submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's post-processing from files: each run writes one JSON-array result
    file set per attribute (``run=<n>/attr=<a>``), the sets are read back and merged per id
    (later run wins), sorted by id and written as the JSON-lines submission, whose lines are
    read back with their positions."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = stored_items(spark, sf_dir)
    base = scratch_path(spark, "submission")
    longs = []
    for run, (split, attrs) in enumerate((("train", _RUN0), ("val", _RUN1))):
        mj = MD.majority_label(it.filter(F.col("split") == split), "retailer", attrs)
        longs.append(it.select("id", "retailer").join(mj, "retailer").select(
            F.lit(run).alias("run"), "attr", F.col("id").alias("indoml_id"), F.col("predicted").alias("value")))
    # one pass over the union: the arrays are cut by bytes as they are written
    SK.write_json_arrays(longs[0].unionByName(longs[1]), f"{base}/results", by=["run", "attr"])
    res = RC.read_json_array(spark, f"{base}/results", "indoml_id bigint, value string")
    long = res.select(F.col("indoml_id").alias("id"), "attr", "value", F.col("run").cast("bigint").alias("seq"))
    merged = MG.merge_attributes(long, ATTRS)
    SK.write_jsonl(merged.orderBy("id"), f"{base}/submission")
    # each line with its place in the files, so that the order is checked too
    lines = RC.read_numbered_lines(spark, f"{base}/submission", "pos")
    rec = F.from_json("value", "id bigint, supergroup string, `group` string, module string, brand string")
    return lines.select("pos", rec.alias("r")).select("pos", "r.*")


def _monthly(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("attr"),
                      (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("epoch")) \
             .agg((F.sum(F.round(value * 100).cast("bigint")) / F.count(F.lit(1))).alias("score"))


def _stopping_sql(value: str, keep: str, better: str, worst: str, best: str, patience: int) -> str:
    """Early stopping in SQL: a run of evaluations without improvement is numbered inside its island."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
WITH m AS (SELECT l_returnflag AS attr, year(l_shipdate) * 12 + month(l_shipdate) AS epoch,
                  sum(CAST(round({value} * 100) AS BIGINT)) / count(*) AS score
           FROM lineitem GROUP BY 1, 2),
k AS (SELECT * FROM m WHERE {keep}),
i AS (SELECT *, coalesce(score {better} {worst}(score) OVER (PARTITION BY attr ORDER BY epoch {frame} 1 PRECEDING), {'score > 0' if better == '>' else 'true'})
             {'AND score > 0' if better == '>' else ''} AS imp FROM k),
g AS (SELECT *, sum(CAST(imp AS INTEGER)) OVER (PARTITION BY attr ORDER BY epoch {frame} CURRENT ROW) AS island FROM i),
f AS (SELECT *, count(*) FILTER (NOT imp) OVER (PARTITION BY attr, island ORDER BY epoch {frame} CURRENT ROW) AS fails FROM g),
s AS (SELECT attr, coalesce(min(epoch) FILTER (fails >= {patience}), max(epoch)) AS stop_epoch, {best}(score) AS best_score FROM f GROUP BY attr)
SELECT f.attr, min(f.epoch) FILTER (WHERE f.score = s.best_score) AS best_epoch, s.best_score, s.stop_epoch,
       max(f.epoch) FILTER (WHERE f.imp AND f.epoch <= s.stop_epoch) AS best_epoch_at_stop
FROM f JOIN s ON f.attr = s.attr GROUP BY f.attr, s.best_score, s.stop_epoch"""


_STOP_COLS = ("attr", "best_epoch", "best_score", "stop_epoch", "best_epoch_at_stop")


@query("best_epoch", _stopping_sql("l_discount", "epoch % 3 <> 1", ">", "max", "max", 3))
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best epoch and early stop (patience 3) over a per-flag score table with gaps between its epochs
    (every third month was not evaluated)."""
    m = _monthly(spark, sf_dir, F.col("l_discount")).filter(F.col("epoch") % 3 != 1)
    return MT.best_epoch(m, "attr", "epoch", "score", patience=3).select(*_STOP_COLS)


@query("best_epoch_loss", _stopping_sql("l_tax", "true", "<", "min", "min", 10))
def q_best_epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a loss (smaller is better, patience 10)."""
    m = _monthly(spark, sf_dir, F.col("l_tax"))
    return MT.best_epoch(m, "attr", "epoch", "score", patience=10, greater=False).select(*_STOP_COLS)


# ------------------------------------------------------------------ models and generation

def _report(train: DataFrame, test: DataFrame, attr: str, label: str, n_classes: int) -> DataFrame:
    """The head's report on its training rows and, as ``test_*``, on the test split."""
    fit, held = MT.head_report(train, label, n_classes), MT.head_report(test, label, n_classes)
    flags = ("beats_majority", "beats_uniform", "argmax_agrees")
    rows = fit.select(F.lit(attr).alias("attr"), F.lit("train").alias("on"), "n", *flags).unionByName(
        held.select(F.lit(attr).alias("attr"), F.lit("test").alias("on"), "n", *flags))
    one = lambda c, on: F.max(F.when(F.col("on") == on, F.col(c)))
    return rows.groupBy("attr").agg(one("n", "test").alias("n_test"), one("n", "train").alias("n_train"),
                                    *(one(c, "train").alias(c) for c in flags), one("argmax_agrees", "test").alias("test_argmax_agrees"))


_TRUE_SQL = "true AS beats_majority, true AS beats_uniform, true AS argmax_agrees, true AS test_argmax_agrees"


@query("linear_head", f"""
SELECT 'label' AS attr, count(*) FILTER (vec_id % 10 = 0) AS n_test, count(*) FILTER (vec_id % 10 <> 0) AS n_train, {_TRUE_SQL}
FROM embeddings""")
def q_linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax head fitted on train+val embeddings: the fit's quality on its own rows (accuracy against the majority
    label, cross-entropy of its probabilities against the uniform loss, argmax), and its test rows scored and counted.
    ``linear_head_labels`` returns the test predictions, ``linear_head_test`` how good they are."""
    return _heads(spark, sf_dir, ["label"])[0]


def _heads(spark: SparkSession, sf_dir: str, attrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a report row per attribute, the scored test rows: ``vec_id, attr, label, prediction, probability``)."""
    from facetspark.plans.catalog import split_of
    emb = (table(spark, sf_dir, "embeddings").withColumn("split", split_of(F.col("vec_id")))
           .withColumn("coarse", F.floor(F.col("label") / 5).cast("int")))
    train, test = emb.filter(F.col("split") != "test"), emb.filter(F.col("split") == "test")
    models = MD.fit_per_attribute(train, "embedding", attrs, max_iter=30)
    outs = rows = None
    for a, m in models.items():
        scored = MD.score_linear_head(m, test, "embedding", "vec_id", keep=[a])
        one = _report(MD.score_linear_head(m, train, "embedding", "vec_id", keep=[a]), scored, a, a, m.numClasses)
        held = scored.select("vec_id", F.lit(a).alias("attr"), F.col(a).cast("int").alias("label"), "prediction", "probability")
        outs, rows = (one, held) if outs is None else (outs.unionByName(one), rows.unionByName(held))
    return outs, rows


@query("linear_heads", f"""
SELECT attr, count(*) FILTER (vec_id % 10 = 0) AS n_test, count(*) FILTER (vec_id % 10 <> 0) AS n_train, {_TRUE_SQL}
FROM embeddings, (VALUES ('label'), ('coarse')) a(attr) GROUP BY attr""")
def q_linear_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear head per attribute (the label and its coarse half, label // 5), each reported like ``linear_head``."""
    return _heads(spark, sf_dir, ["label", "coarse"])[0]


@query("linear_head_labels")
def q_linear_head_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both heads' predictions for every test row: the label, the predicted one and its probability."""
    rows = _heads(spark, sf_dir, ["label", "coarse"])[1]
    return rows.select("vec_id", "attr", "label", "prediction", F.round(F.array_max("probability"), 6).alias("probability"))


@query("linear_head_test")
def q_linear_head_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both heads judged on the test split: accuracy, macro scores and cross-entropy per attribute."""
    from facetspark.session import store
    rows = store(_heads(spark, sf_dir, ["label", "coarse"])[1], "scored")
    names = ("n", "accuracy", "precision", "recall", "f1", "cross_entropy")
    out = None
    for a in ("label", "coarse"):
        one = rows.filter(F.col("attr") == a)
        for part in (MT.macro_metrics(one, "label", "prediction"), MT.cross_entropy(one, "probability", "label").drop("n")):
            held = part.select(F.lit(a).alias("attr"), *(F.col(c) if c in part.columns else F.lit(None).cast("double").alias(c) for c in names))
            out = held if out is None else out.unionByName(held)
    return out.groupBy("attr").agg(F.max("n").cast("bigint").alias("n"), *(F.max(c).alias(c) for c in names[1:]))


@query("sharded_head", """
SELECT count(*) FILTER (vec_id % 10 = 0) AS n_test, count(*) FILTER (vec_id % 10 <> 0) AS n_train, true AS agrees, true AS loss_ok
FROM embeddings""")
def q_sharded_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head for very many classes (its weights a table of class shards, here of 4 classes) against the plain head:
    with the same
    penalty at least 0.95 of the test predictions equal, and the training loss within 0.005."""
    from facetspark.plans.catalog import split_of
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", split_of(F.col("vec_id")).alias("split"))
    train = emb.filter(F.col("split") != "test")
    head = SS.fit_sharded_head(train, "embedding", "label", id_col="vec_id", shard_classes=4, iterations=12, reg=0.01)
    plain = MD.fit_linear_head(train, "embedding", "label", max_iter=50, reg=0.01, standardize=False)
    ours = SS.score_sharded_head(head, emb, "embedding", "vec_id", "label").select("vec_id", F.col("prediction").alias("ours"), "loss")
    both = MD.score_linear_head(plain, emb, "embedding", "vec_id", keep=["label", "split"]).join(ours, "vec_id")
    test = F.col("split") == "test"
    other = -F.log(F.greatest(MT.true_probability("probability", "label"), F.lit(1e-12)))
    return both.agg(F.count_if(test).alias("n_test"), F.count_if(~test).alias("n_train"),
                    (F.avg(F.when(test, (F.col("ours") == F.col("prediction")).cast("int"))) >= 0.95).alias("agrees"),
                    (F.abs(F.avg(F.when(~test, F.col("loss"))) - F.avg(F.when(~test, other))) <= 0.005).alias("loss_ok"))


def _epoch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of two heads trained by epochs (the label and its coarse half), with each attribute's selected epoch."""
    from facetspark.plans.catalog import split_of
    emb = (table(spark, sf_dir, "embeddings").withColumn("split", split_of(F.col("vec_id")))
           .withColumn("coarse", F.floor(F.col("label") / 5).cast("int")))
    train, val = emb.filter(F.col("split") == "train"), emb.filter(F.col("split") == "val")
    out = None
    for a in ("label", "coarse"):
        run = EP.train_epochs(train, val, "embedding", a, attr=a, id_col="vec_id", epochs=5, batch_rows=64, partitions=4)
        best = MT.best_epoch(run.history, "attr", "epoch", "val_f1", patience=5)
        one = run.history.join(best.select("attr", "best_epoch"), "attr").withColumn("kept", F.lit(run.best))
        out = one if out is None else out.unionByName(one)
    return out


@query("training_epochs", """
SELECT attr, epoch, count(*) FILTER (vec_id % 10 > 2) AS n_train, count(*) FILTER (vec_id % 10 IN (1, 2)) AS n_val,
       true AS scored, true AS learns, true AS kept_best
FROM embeddings, (VALUES ('label'), ('coarse')) a(attr), range(1, 6) e(epoch) GROUP BY attr, epoch""")
def q_training_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads trained by epochs of mini-batches: a row per attribute and epoch, whether it was scored, whether the
    last training loss is below the first, and whether the weights kept are those of ``best_epoch``.
    ``training_losses`` returns the figures."""
    t = _epoch_runs(spark, sf_dir)
    ends = t.groupBy("attr").agg((F.max_by("train_loss", "epoch") < F.min_by("train_loss", "epoch")).alias("learns"))
    return t.join(ends, "attr").select("attr", "epoch", "n_train", "n_val", F.expr("val_loss IS NOT NULL AND val_f1 IS NOT NULL").alias("scored"),
                                       "learns", (F.col("kept") == F.col("best_epoch")).alias("kept_best"))


@query("training_losses")
def q_training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table's figures: training and validation loss, accuracy and macro F1 per epoch, and the selected epoch."""
    return _epoch_runs(spark, sf_dir).select("attr", "epoch", "train_loss", "val_loss", "val_accuracy", "val_f1", "best_epoch")


def _classifier(spark: SparkSession, sf_dir: str, report: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(one report row per attribute, the merged test predictions).

    Per attribute: vocabulary from the val labels, train labels encoded (unseen -> class 0,
    as the reference does), one multinomial linear head fitted on the train items' vectors,
    the test split scored, indexes decoded back to labels; the per-attribute predictions
    are then merged into one record per id."""
    from facetspark.session import store
    it = _vec_items(spark, sf_dir, "id", "split", *ATTRS)
    vocab = VC.build_vocab(it.filter(F.col("split") == "val"), ATTRS)
    enc = it
    for a in ATTRS:
        enc = VC.map_labels(enc, vocab, a, f"y_{a}", unknown="zero")
    # every fit iterates over this table: encode once, store what the fits read
    enc = store(enc.select("id", "split", "embedding", *(f"y_{a}" for a in ATTRS)), "encoded")
    train, test = enc.filter(F.col("split") == "train"), enc.filter(F.col("split") == "test")
    models = MD.fit_per_attribute(train, "embedding", [f"y_{a}" for a in ATTRS], max_iter=20)
    longs, reports = [], None
    for a in ATTRS:
        y, m = f"y_{a}", models[f"y_{a}"]
        scored = store(MD.score_linear_head(m, test, "embedding", "id", keep=[y]), "predictions")
        dec = VC.decode_labels(scored.select("id", F.col("prediction").alias("idx"), F.lit(a).alias("attr")), vocab, out_col="value")
        longs.append(dec.select("id", "attr", "value", F.lit(0).cast("bigint").alias("seq")))
        if report:
            r = _report(MD.score_linear_head(m, train, "embedding", "id", keep=[y]), scored, a, y, m.numClasses)
            reports = r if reports is None else reports.unionByName(r)
    if report:
        known = VC.encode_labels(it.filter(F.col("split") == "train"), vocab, ATTRS)
        known = known.groupBy("attr").agg(F.count("idx").alias("n_in_vocab"))
        reports = reports.join(known, "attr")
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)
    return reports, MG.merge_attributes(long, ATTRS)


@query("classifier_predict", _with_items(f"""
a AS (SELECT unnest([{", ".join(f"'{a}'" for a in ATTRS)}]) AS attr),
l AS ({" UNION ALL ".join(f"SELECT id, split, '{a}' AS attr, CAST(\"{a}\" AS VARCHAR) AS label FROM items" for a in ATTRS)}),
v AS (SELECT DISTINCT attr, label FROM l WHERE split = 'val' AND label IS NOT NULL)
SELECT l.attr, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train') AS n_train, {_TRUE_SQL},
       count(v.label) FILTER (split = 'train') AS n_in_vocab,
       count(*) FILTER (split = 'test') AS n_decoded
FROM l LEFT JOIN v ON v.attr = l.attr AND v.label = l.label GROUP BY l.attr"""))
def q_classifier_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier pipeline end to end over every item; per attribute the test rows, the train rows and how
    many of their labels are in the vocabulary, whether the fit beats the majority label and the uniform loss
    on its rows, and how many merged test records carry a label of the vocabulary."""
    from facetspark.session import store
    report, merged = _classifier(spark, sf_dir)
    it = stored_items(spark, sf_dir, "split", *ATTRS).filter(F.col("split") == "val")
    known = VC.unpivot_labels(it, ATTRS, None).distinct()
    pred = VC.unpivot_labels(store(merged, "merged"), ATTRS, "id").join(known, ["attr", "label"], "left_semi")
    decoded = pred.groupBy("attr").agg(F.count(F.lit(1)).alias("n_decoded"))
    return report.join(decoded, "attr")


@query("classifier_labels")
def q_classifier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's merged predictions, one record per test item (``classifier_predict`` checks them)."""
    return _classifier(spark, sf_dir, report=False)[1]


@query("generate_extract", _fewshot_sql("true") + """
SELECT id, coalesce(supergroup, 'na') AS supergroup, coalesce("group", 'na') AS "group", coalesce(module, 'na') AS module,
       coalesce(brand, 'na') AS brand FROM voted""")
def q_generate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's seq2seq input text with examples of similar items -> plug-in generator over Arrow batches
    (the default answers with the examples' majority as target text) -> extraction -> records."""
    asked, _ = _fewshot(spark, sf_dir, all_items=True)
    prompts = asked.select("id", F.concat("learning_input", F.lit("\n\n"), _input_text()).alias("prompt"))
    return X.extract_attributes(MD.generate(prompts, "prompt", "vote_text"), "generated", ATTRS)


_GEN_DIMS = 64


def _trained_generation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    """(id and prompt of every item, fitted head per attribute, their vocabulary, item vectors): heads trained on the
    train items' hashed input texts."""
    from facetspark.session import store
    it = items(spark, sf_dir)
    rows = it.select("id", "split", _input_text().alias("prompt"), *ATTRS)
    rows = store(rows.withColumn("embedding", RT.text_vector(F.col("prompt"), _GEN_DIMS)), "prompts")
    train = rows.filter(F.col("split") == "train")
    vocab = VC.build_vocab(train, ATTRS)
    enc = train
    for a in ATTRS:
        enc = VC.map_labels(enc, vocab, a, f"y_{a}")
    enc = store(enc.select("embedding", *(f"y_{a}" for a in ATTRS)), "encoded")
    models = MD.fit_per_attribute(enc, "embedding", [f"y_{a}" for a in ATTRS], max_iter=10)
    return rows.select("id", "prompt"), {a: models[f"y_{a}"] for a in ATTRS}, vocab, rows.select("id", "embedding")


def _generated(prompts: DataFrame, models: dict, vocab: DataFrame) -> DataFrame:
    # the labels of a head: bounded with it (MAX_COEFFICIENTS)
    labels: dict = {a: [] for a in ATTRS}
    for r in vocab.orderBy("attr", "idx").collect():
        labels[r["attr"]].append(r["label"])
    generator = MD.head_text_generator([(a, models[a], labels[a]) for a in ATTRS], _GEN_DIMS)
    return X.extract_attributes(MD.generate(prompts, "prompt", generator), "generated", ATTRS)


@query("generate_trained")
def q_generate_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's input text -> a generator trained on the train items (linear heads on hashed words) over Arrow
    batches -> target text -> extraction -> records; ``generate_trained_check`` holds them against the heads."""
    prompts, models, vocab, _ = _trained_generation(spark, sf_dir)
    return _generated(prompts, models, vocab)


@query("generate_trained_check", "SELECT attr, count(*) AS n, true AS agrees FROM part, (VALUES " + ", ".join(f"('{a}')" for a in ATTRS)
       + ") a(attr) GROUP BY attr")
def q_generate_trained_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per attribute: the generated and extracted labels against the same heads applied to the stored vectors and
    decoded; they may differ only where two classes tie (in one row of a thousand at most)."""
    prompts, models, vocab, vectors = _trained_generation(spark, sf_dir)
    ours = VC.unpivot_labels(_generated(prompts, models, vocab), ATTRS)
    direct = None
    for a in ATTRS:
        one = MD.score_linear_head(models[a], vectors, "embedding", "id").select("id", F.lit(a).alias("attr"), F.col("prediction").alias("idx"))
        direct = one if direct is None else direct.unionByName(one)
    direct = VC.decode_labels(direct, vocab, out_col="direct")
    both = ours.join(direct, ["id", "attr"])
    return both.groupBy("attr").agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("label") == F.col("direct")).cast("int")) >= 0.999).alias("agrees"))


@query("instruction_predict", _fewshot_sql("true") + """
SELECT id, supergroup, "group", module, brand FROM voted""")
def q_instruction_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction-tuned pipeline end to end: examples and instruction prompt per record -> plug-in
    generator over Arrow batches -> ``{id, prompt, output}`` rows appended as JSON lines (the
    id is carried, where the reference kept only prompt and output) -> output JSON parsed."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    asked, _ = _fewshot(spark, sf_dir, all_items=True)
    prompts = INS.instruction_prompts(asked, *INPUTS).select(
        "id", F.concat("learning_input", F.lit("\n\n"), "prompt").alias("prompt"))
    out = MD.generate(prompts, "prompt", "vote_json", out_col="output")
    path = scratch_path(spark, "instruction_predict")
    SK.append_jsonl(out, path)
    back = RC.read_jsonl(spark, path, "id bigint, prompt string, output string")
    labels = "supergroup string, `group` string, module string, brand string"
    return back.select("id", F.from_json("output", labels).alias("r")).select("id", *[F.col("r")[a].alias(a)
                                                                                      for a in ATTRS])


@query("reply_parse", f"""
WITH r AS (
  SELECT p_partkey AS id,
    CASE p_partkey % 5
      WHEN 0 THEN '{{"result": "no marker {{\\"brand\\": \\"' || p_brand || '\\"}}"}}'
      WHEN 1 THEN '{{"result": "\\n{{\\"brand\\": \\"' || p_brand || '\\", \\"module\\": \\"'
                  || regexp_extract(p_name, '([^ ]+)$', 1) || '\\"}}"}}'
      WHEN 2 THEN '{{"result": "\\noutput: {{\\"brand\\": \\"' || p_brand || '\\"}} extra"}}'
      WHEN 3 THEN '{{"result": "\\n{{\\n \\"brand\\": \\"' || p_brand || '\\"\\n}}"}}'
      ELSE '{{"result": "\\n }} {{\\"brand\\": \\"' || p_brand || '\\"}}"}}'
    END AS body
  FROM part),
c AS (SELECT id, body, CASE WHEN strpos(body, '\\n') > 0 THEN
        regexp_replace(regexp_extract(split_part(body, '\\n', 2), '^[^{{}}]*(\\{{[^}}]*\\}})', 1), '[\\n\\\\]', '', 'g')
      END AS cleaned FROM r)
SELECT id, cleaned,
       CASE WHEN json_valid(cleaned) THEN json_extract_string(cleaned, '$.brand') END AS brand,
       CASE WHEN json_valid(cleaned) THEN json_extract_string(cleaned, '$.module') END AS module,
       CASE WHEN coalesce(json_valid(cleaned), false) THEN NULL ELSE body END AS _corrupt
FROM c""")
def q_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies rendered from ``part`` (5 shapes: no marker, clean, wrapped, multi-line,
    stray brace) -> cleaned JSON text -> typed fields; failures are NULL, never a crash, and keep
    their text in ``_corrupt``."""
    p = table(spark, sf_dir, "part")
    b, mod = F.col("p_brand"), last_word(F.col("p_name"))
    v = F.pmod(F.col("p_partkey"), F.lit(5))
    body = (F.when(v == 0, F.concat(F.lit('{"result": "no marker {\\"brand\\": \\"'), b, F.lit('\\"}"}')))
            .when(v == 1, F.concat(F.lit('{"result": "\\n{\\"brand\\": \\"'), b, F.lit('\\", \\"module\\": \\"'),
                                   mod, F.lit('\\"}"}')))
            .when(v == 2, F.concat(F.lit('{"result": "\\noutput: {\\"brand\\": \\"'), b, F.lit('\\"} extra"}')))
            .when(v == 3, F.concat(F.lit('{"result": "\\n{\\n \\"brand\\": \\"'), b, F.lit('\\"\\n}"}')))
            .otherwise(F.concat(F.lit('{"result": "\\n } {\\"brand\\": \\"'), b, F.lit('\\"}"}'))))
    replies = p.select(F.col("p_partkey").alias("id"), body.alias("body"))
    return X.parse_reply(replies, "body", "brand string, module string", keep_corrupt=True)


# ------------------------------------------------------------------ sinks and streaming

@query("sink_roundtrip", _with_items("""
SELECT 'json' AS fmt, id, description, retailer, price, brand, split FROM items
UNION ALL SELECT 'csv', id, description, retailer, price, brand, split FROM items
UNION ALL SELECT 'parquet', id, description, retailer, price, brand, split FROM items"""))
def q_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as JSON lines, CSV and split-partitioned Parquet under the shared
    checkpoint folder, then read back with explicit schemas."""
    from facetspark.session import scratch_path
    from facetspark.sources import sinks as SK
    it = items(spark, sf_dir).select("id", "description", "retailer", "price", "brand", "split")
    base = scratch_path(spark, "sink_roundtrip")
    # the view is computed once: the partitioned table is written first and the other
    # formats are written from it (a stored table also cuts the lineage)
    SK.write_partitioned(it, f"{base}/parquet", ["split"])
    stored = spark.read.parquet(f"{base}/parquet")
    SK.write_jsonl(stored, f"{base}/json", mode="overwrite")
    SK.write_csv(stored, f"{base}/csv")
    schema = "id bigint, description string, retailer string, price double, brand string, split string"
    j = RC.read_jsonl(spark, f"{base}/json", schema)
    c = RC.read_csv(spark, f"{base}/csv", schema)
    pq = spark.read.parquet(f"{base}/parquet").select("id", "description", "retailer", "price", "brand", "split")
    cols = ["id", "description", "retailer", "price", "brand", "split"]
    return (j.select(F.lit("json").alias("fmt"), *cols)
            .unionByName(c.select(F.lit("csv").alias("fmt"), *cols))
            .unionByName(pq.select(F.lit("parquet").alias("fmt"), *cols)))


def _part_labels(df: DataFrame) -> DataFrame:
    txt = render_fields([("supergroup", F.col("p_type")),
                         ("group", F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string"))),
                         ("module", last_word(F.col("p_name"))), ("brand", F.col("p_brand"))])
    return X.extract_attributes(df.select(F.col("p_partkey").alias("id"), txt.alias("txt")), "txt", ATTRS)


@query("stream_extract", _fewshot_sql() + """
SELECT i.id, coalesce(v.supergroup, 'na') AS supergroup, coalesce(v."group", 'na') AS "group",
       coalesce(v.module, 'na') AS module, coalesce(v.brand, 'na') AS brand
FROM (SELECT id FROM items WHERE split = 'test') i JOIN voted v ON v.id = i.id""")
def q_stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain as a file stream over raw record lines of the test items: lenient parse -> input text
    with the item's stored examples (stream-static join) -> generator -> extraction -> JSON file sink
    (checkpointed, availableNow), then the sink folder read back."""
    from facetspark.session import scratch_path, store
    from facetspark.streaming.file_stream import run_stream
    asked, _ = _fewshot(spark, sf_dir)
    base = scratch_path(spark, "stream_extract")
    line = F.concat(F.lit('{"indoml_id": '), F.col("id").cast("string"), F.lit(', "description": "'), F.col("description"),
                    F.coalesce(F.concat(F.lit('", "retailer": "'), F.col("retailer")), F.lit("")),
                    F.lit('", "price": '), F.col("price").cast("string"), F.lit("}"))
    asked.select(line.alias("value")).write.text(f"{base}/in")
    examples = store(asked.select("id", "learning_input"), "examples")

    def chain(lines: DataFrame) -> DataFrame:
        good, _rejects = RC.parse_records(lines)
        rec = RC.project_keys(good, INPUTS).join(examples, "id", "left")
        text = render_fields([(c, F.col(c)) for c in INPUTS])
        prompts = rec.select("id", F.concat(F.coalesce("learning_input", F.lit("")), F.lit("\n\n"), text).alias("prompt"))
        return X.extract_attributes(MD.generate(prompts, "prompt", "vote_text"), "generated", ATTRS)

    run_stream(spark, f"{base}/in", StructType([StructField("value", StringType())]), chain, f"{base}/out", f"{base}/ckpt",
               fmt="text", timeout_s=600)
    return spark.read.schema("id bigint, supergroup string, `group` string, module string, brand string") \
                .json(f"{base}/out")


_PART_LABELS_SQL = """
p AS (SELECT p_partkey AS id, p_type AS supergroup, p_type || ' ' || CAST(p_size AS VARCHAR) AS "group",
             regexp_extract(p_name, '([^ ]+)$', 1) AS module, p_brand AS brand FROM part)"""


@query("stream_encode", f"""
WITH {_PART_LABELS_SQL.strip()},
l AS ({" UNION ALL ".join(f"SELECT id, '{a}' AS attr, \"{a}\" AS label FROM p" for a in ATTRS)}),
v AS (SELECT attr, label, dense_rank() OVER (PARTITION BY attr ORDER BY label) - 1 AS idx
      FROM (SELECT DISTINCT attr, label FROM l WHERE label IS NOT NULL))
SELECT l.id, l.attr, l.label, v.idx FROM l LEFT JOIN v ON v.attr = l.attr AND v.label = l.label""")
def q_stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a file stream -> extraction -> label encoding by a stream-static join against a
    vocabulary built once from the static table (checkpointed) -> JSON file sink, read back."""
    from facetspark.session import scratch_path
    from facetspark.streaming.file_stream import run_stream
    from facetspark.sources import sinks as SK
    part = table(spark, sf_dir, "part")
    base = scratch_path(spark, "stream_encode")
    # the static side is a stored table, partitioned by attribute, read back once
    SK.write_partitioned(VC.build_vocab(_part_labels(part), ATTRS).select("attr", "label", "idx"),
                         f"{base}/vocab", ["attr"])
    vocab = SK.read_vocab(spark, f"{base}/vocab")

    def transform(stream: DataFrame) -> DataFrame:
        return VC.encode_labels(_part_labels(stream), vocab, ATTRS)

    run_stream(spark, sf_dir, part.schema, transform, f"{base}/out", f"{base}/ckpt", glob="part.parquet",
               timeout_s=600)
    return spark.read.schema("id bigint, attr string, label string, idx bigint").json(f"{base}/out")


@query("stream_append_once", """
SELECT event_id, user_id, event_type, value FROM events""")
def q_stream_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events appended by a file stream that keeps their ids in its state: the whole input is then delivered a second
    time, the stream restarted from its checkpoint, and every event is in the sink once (watermark over the
    table's month)."""
    from facetspark.session import scratch_path
    from facetspark.streaming.file_stream import once_by, run_stream
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    base = scratch_path(spark, "stream_append_once")
    for _ in range(2):
        events.write.mode("append").parquet(f"{base}/in")
        run_stream(spark, f"{base}/in", events.schema, lambda d: once_by(d, "event_id", "ts", "45 days").drop("ts"),
                   f"{base}/out", f"{base}/ckpt", timeout_s=600)
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, value double").json(f"{base}/out")
