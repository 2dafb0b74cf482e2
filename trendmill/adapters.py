"""The given tables seen as video tables.

``videos``       one row per order, natural nulls, bad categories and regions
``trending``     one row per order line: raw rows with repeated video ids
``doc_videos``   one row per document: title, description and tags as text
``event_videos`` one row per event: a time-ordered feed
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.session import use_utc

_REGION_CODES = {"AMERICA": "US", "EUROPE": "GB", "ASIA": "IN", "AFRICA": "FR"}


_SCHEMAS: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Its schema is read from the footer once per session and path."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = use_utc(spark).read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def _region_code(name):
    out = None
    for region, code in _REGION_CODES.items():
        out = F.when(name == region, code) if out is None else out.when(name == region, code)
    return out.otherwise("XX")


def _hours_later(ts, hours):
    return F.timestamp_add("HOUR", hours.cast("int"), ts)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos.

    Lines are summed per order before they meet the orders, so the join moves
    one row per order; nation and region are small by definition and Spark
    broadcasts them from their file sizes.  Customers carry no hint: they grow.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    base = (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    key = F.col("o_orderkey")
    publish = _hours_later(F.col("o_orderdate"), key % 24)
    trending = _hours_later(F.col("o_orderdate"), key % 24 + F.col("o_custkey") % 240)
    return base.select(
        F.concat(F.lit("v"), key).alias("video_id"),
        key.alias("seq"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.when(key % 6 == 0, F.lit(None).cast("string"))
        .when(key % 9 == 1, "")
        .otherwise(F.concat_ws(" ", "c_mktsegment", F.lit("fun tutorial from"), "n_name",
                               F.lit("see http://example.org")))
        .alias("description"),
        F.when(key % 17 == 0, F.lit(None).cast("string"))
        .when(key % 13 == 0, "")
        .when(key % 11 == 0, "[none]")
        .when(key % 7 == 0, F.concat(F.lower("c_mktsegment"), F.lit("|"), F.col("c_mktsegment"),
                                     F.lit(", school;music")))
        .otherwise(F.concat_ws("|", "o_orderstatus", "c_mktsegment", "r_name"))
        .alias("tags"),
        (F.lit(1) + key % 47).cast("int").alias("category_id"),
        F.concat(F.lit("ch"), "o_custkey").alias("channel_id"),
        F.col("c_name").alias("channel_title"),
        publish.alias("publish_date"),
        F.when(F.col("n_lines").isNotNull(), trending).alias("trending_date"),
        _region_code(F.col("r_name")).alias("region_code"),
        F.floor(F.col("o_totalprice") * 4).cast("long").alias("views"),
        (F.col("qty") * 100).cast("long").alias("likes"),
        (F.col("n_lines") * 50).cast("long").alias("comments"),
        F.concat(F.lit("PT"), key * 7 % 41, F.lit("M"), key % 60, F.lit("S")).alias("duration"),
    )


VIDEOS_SQL = """
videos AS (
  SELECT 'v' || o_orderkey AS video_id, o_orderkey AS seq,
    o_orderpriority || ' ' || c_mktsegment AS title,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN ''
      ELSE c_mktsegment || ' fun tutorial from ' || n_name || ' see http://example.org' END AS description,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ''
      WHEN o_orderkey % 11 = 0 THEN '[none]'
      WHEN o_orderkey % 7 = 0 THEN lower(c_mktsegment) || '|' || c_mktsegment || ', school;music'
      ELSE o_orderstatus || '|' || c_mktsegment || '|' || r_name END AS tags,
    CAST(1 + o_orderkey % 47 AS INTEGER) AS category_id,
    'ch' || o_custkey AS channel_id, c_name AS channel_title,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS publish_date,
    CASE WHEN n_lines IS NOT NULL
      THEN o_orderdate + to_hours(CAST(o_orderkey % 24 + o_custkey % 240 AS INTEGER)) END AS trending_date,
    CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'GB' WHEN 'ASIA' THEN 'IN'
      WHEN 'AFRICA' THEN 'FR' ELSE 'XX' END AS region_code,
    CAST(floor(o_totalprice * 4) AS BIGINT) AS views,
    CAST(qty * 100 AS BIGINT) AS likes, n_lines * 50 AS comments,
    'PT' || (o_orderkey * 7 % 41) || 'M' || (o_orderkey % 60) || 'S' AS duration
  FROM orders
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n_lines
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
)"""


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trending rows: (order, line number) repeats, as raw video ids do."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    key, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    views = F.floor(F.col("l_extendedprice") * 100).cast("long")
    nothing = F.lit(None)
    return lines.join(orders, key == F.col("o_orderkey")).select(
        F.concat_ws("-", key, "l_linenumber").alias("video_id"),
        F.concat_ws(" ", F.lit("Line"), "l_returnflag", "l_linestatus").alias("title"),
        F.when(supplier % 5 == 0, nothing.cast("string")).when(supplier % 5 == 1, "")
        .otherwise(F.concat(F.lit("  Shipped   as "), "l_returnflag")).alias("description"),
        F.when(part % 7 == 0, nothing.cast("string")).when(part % 7 == 1, "")
        .otherwise(F.concat(F.lit("line|"), "l_linestatus", F.lit("|#"), "l_returnflag")).alias("tags"),
        (F.lit(1) + part % 47).cast("int").alias("category_id"),
        F.concat(F.lit("c"), "o_custkey").alias("channel_title"),
        F.col("o_orderdate").alias("publish_date"),
        F.when(part % 31 != 0, F.col("l_shipdate")).alias("trending_date"),
        F.when(supplier % 3 == 0, "US").when(supplier % 3 == 1, "GB").otherwise("IN").alias("region_code"),
        F.when(part % 29 == 0, -views).otherwise(views).alias("views"),
        F.when(part % 37 != 0, F.col("l_quantity") * 100).cast("long").alias("likes"),
        (part % 500).alias("comments"),
    )


TRENDING_SQL = """
trending AS (
  SELECT l_orderkey || '-' || l_linenumber AS video_id,
    'Line ' || l_returnflag || ' ' || l_linestatus AS title,
    CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '  Shipped   as ' || l_returnflag END AS description,
    CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'line|' || l_linestatus || '|#' || l_returnflag END AS tags,
    CAST(1 + l_partkey % 47 AS INTEGER) AS category_id,
    'c' || o_custkey AS channel_title, o_orderdate AS publish_date,
    CASE WHEN l_partkey % 31 <> 0 THEN l_shipdate END AS trending_date,
    CASE l_suppkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'IN' END AS region_code,
    CAST(floor(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_partkey % 29 = 0 THEN -1 ELSE 1 END AS views,
    CASE WHEN l_partkey % 37 <> 0 THEN CAST(l_quantity * 100 AS BIGINT) END AS likes, l_partkey % 500 AS comments
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

# Decides which of several raw rows of one video is the last one.
TRENDING_ORDER = ["trending_date", "views", "likes", "comments", "region_code", "title"]


def doc_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as videos; the whole text is the description."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.concat_ws("|", "lang", "source").alias("tags"),
        F.col("source").alias("channel_title"),
        (F.lit(1) + F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % 29).alias("category_id"),
        F.col("lang").alias("region_code"),
        "doc_id",
    )


DOCS_SQL = r"""
doc_videos AS (
  SELECT CAST(doc_id AS VARCHAR) AS video_id, split_part(text, chr(10), 1) AS title,
    text AS description, lang || '|' || source AS tags, source AS channel_title,
    CAST(1 + CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 29 AS INTEGER) AS category_id,
    lang AS region_code, doc_id
  FROM documents
)"""


def event_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed of view counts in time order."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("channel_title"),
        F.col("ts").alias("publish_date"),
        F.floor(F.col("value") * 100).cast("long").alias("views"),
        "user_id",
    )


EVENTS_SQL = """
event_videos AS (
  SELECT 'e' || event_id AS video_id, event_id AS seq, event_type AS channel_title,
    ts AS publish_date, CAST(floor(value * 100) AS BIGINT) AS views, user_id
  FROM events
)"""
