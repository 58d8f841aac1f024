"""Table access and the canonical product-item view over the driver's tables.

The reference's dataset (product text + label solution) isn't available, so
the operators run on ``part`` (+ ``lineitem``, ``supplier``):

  id, description, price          <- p_partkey, p_name, p_retailprice
  retailer                        <- smallest supplier name among the part's sellers
                                     (missing for every 7th part, to exercise missing values)
  supergroup, group, module, brand <- p_type, p_type + ' ' + p_size, last word of p_name, p_brand
  split                           <- test / val / train by id (10% / 20% / 70%)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.functions.text import last_word

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
INPUTS = ("description", "retailer", "price")
ATTRS = ("supergroup", "group", "module", "brand")
# phase-1 schema: three inputs, brand + five category levels (coarse -> fine)
INPUTS_P1 = ("title", "store", "details_Manufacturer")
ATTRS_P1 = ("details_Brand", "L0_category", "L1_category", "L2_category", "L3_category", "L4_category")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(id_col: Column) -> Column:
    """Deterministic split assignment by id."""
    m = F.pmod(id_col, F.lit(10))
    return F.when(m == 0, "test").when(m.isin(1, 2), "val").otherwise("train")


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_partkey, retailer)``: min supplier name per part.

    Distinct (part, supplier) pairs first: a partial aggregate collapses the
    line items before any shuffle, so a supplier or part holding a third of
    all lines costs one row per task, and the join then moves pairs, not lines.
    The supplier side is joined without a hint; AQE broadcasts it only when its
    measured size is under the broadcast threshold.
    """
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (pairs.join(sup, pairs["l_suppkey"] == sup["s_suppkey"])
            .groupBy("l_partkey").agg(F.min("s_name").alias("retailer")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    r = retailers(spark, sf_dir)
    j = part.join(r, part["p_partkey"] == r["l_partkey"], "left")
    pk = F.col("p_partkey")
    return j.select(
        pk.alias("id"),
        F.col("p_name").alias("description"),
        F.when(F.pmod(pk, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.col("retailer")).alias("retailer"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("supergroup"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string")).alias("group"),
        last_word(F.col("p_name")).alias("module"),
        F.col("p_brand").alias("brand"),
        split_of(pk).alias("split"),
    )


def stored_items(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The named columns of the items view (all without names), computed once and stored, for
    queries that use it several times. Naming only columns of ``part`` leaves ``lineitem`` unread."""
    from facetspark.session import store
    it = items(spark, sf_dir)
    return store(it.select(*cols) if cols else it, "items")


def items_phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-1 view: title/store/manufacturer inputs; brand and five category levels as labels.

    title <- p_name; store <- retailer; details_Manufacturer <- first word of p_name;
    details_Brand <- p_brand; L0 <- p_type; L1 <- p_type + size band (S <= 10 < M <= 30 < L);
    L2 <- last word of p_name; L3 <- p_name; L4 <- p_size as text.
    """
    part = table(spark, sf_dir, "part")
    r = retailers(spark, sf_dir)
    j = part.join(r, part["p_partkey"] == r["l_partkey"], "left")
    pk, size = F.col("p_partkey"), F.col("p_size")
    band = F.when(size <= 10, F.lit("S")).when(size <= 30, F.lit("M")).otherwise(F.lit("L"))
    return j.select(
        pk.alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.pmod(pk, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.col("retailer")).alias("store"),
        F.regexp_extract(F.col("p_name"), r"^([^ ]*)", 1).alias("details_Manufacturer"),
        F.col("p_brand").alias("details_Brand"),
        F.col("p_type").alias("L0_category"),
        F.concat(F.col("p_type"), F.lit(" "), band).alias("L1_category"),
        last_word(F.col("p_name")).alias("L2_category"),
        F.col("p_name").alias("L3_category"),
        size.cast("string").alias("L4_category"),
        split_of(pk).alias("split"),
    )


# The same views in DuckDB SQL (CTE prefixes for the oracle queries).
_RETAILERS_SQL = """
    SELECT l.l_partkey, min(s.s_name) AS retailer
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    GROUP BY l.l_partkey
  """
ITEMS_SQL = """
items AS (
  SELECT p.p_partkey AS id,
         p.p_name AS description,
         CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE r.retailer END AS retailer,
         p.p_retailprice AS price,
         p.p_type AS supergroup,
         p.p_type || ' ' || CAST(p.p_size AS VARCHAR) AS "group",
         regexp_extract(p.p_name, '([^ ]+)$', 1) AS module,
         p.p_brand AS brand,
         CASE WHEN p.p_partkey % 10 = 0 THEN 'test'
              WHEN p.p_partkey % 10 IN (1, 2) THEN 'val' ELSE 'train' END AS split
  FROM part p
  LEFT JOIN (""" + _RETAILERS_SQL + """) r ON r.l_partkey = p.p_partkey
)"""

ITEMS_P1_SQL = """
items1 AS (
  SELECT p.p_partkey AS id, p.p_name AS title,
         CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE r.retailer END AS store,
         regexp_extract(p.p_name, '^([^ ]*)', 1) AS details_Manufacturer, p.p_brand AS details_Brand,
         p.p_type AS L0_category,
         p.p_type || ' ' || CASE WHEN p.p_size <= 10 THEN 'S' WHEN p.p_size <= 30 THEN 'M' ELSE 'L' END
           AS L1_category,
         regexp_extract(p.p_name, '([^ ]+)$', 1) AS L2_category, p.p_name AS L3_category,
         CAST(p.p_size AS VARCHAR) AS L4_category
  FROM part p
  LEFT JOIN (""" + _RETAILERS_SQL + """) r ON r.l_partkey = p.p_partkey
)"""
