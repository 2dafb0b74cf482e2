"""C*, J*, U1: cleaning and joining."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import TRENDING_ORDER, doc_videos, trending, videos
from trendmill.operators import clean, enrich, filters, joins, metrics
from trendmill.plans.registry import query
from trendmill.plans.sqltext import (
    RATE, band, enriched_sql, hours, tag_count, titles, videos_sql, with_tables, words,
)
from trendmill.plans.tables import enriched, scored

NOW = "2002-01-01 00:00:00"
_REST = ["description", "tags", "category_id", "channel_title", "publish_date"]
_LAST = ", ".join(f"{c} DESC NULLS LAST" for c in TRENDING_ORDER + _REST)


def survivors(source: str, where: str = "true") -> str:
    return (f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY video_id "
            f"ORDER BY {_LAST}) AS place FROM {source} WHERE {where}) WHERE place = 1")


@query("drop_null_critical", videos_sql("""
SELECT video_id, title, channel_title, views, likes FROM videos
WHERE video_id IS NOT NULL AND title IS NOT NULL AND channel_title IS NOT NULL
  AND views IS NOT NULL AND likes IS NOT NULL"""))
def drop_null_critical(spark, sf):
    return clean.drop_null_critical(videos(spark, sf)).select(*clean.CRITICAL)


@query("dedup_any", with_tables("SELECT DISTINCT video_id FROM trending", "trending"))
def dedup_any(spark, sf):
    """Which row survives is open, so only the keys are shown."""
    return clean.dedup_any(trending(spark, sf)).select("video_id")


@query("dedup_keep_last", with_tables(survivors("trending"), "trending"))
def dedup_keep_last(spark, sf):
    return clean.dedup_keep_last(trending(spark, sf), ["video_id"], TRENDING_ORDER)


@query("fill_missing_text", videos_sql(f"""
SELECT video_id, coalesce(nullif(description, ''), '{K.NO_DESCRIPTION}') AS description,
  coalesce(tags, '') AS tags FROM videos"""))
def fill_missing_text(spark, sf):
    return clean.fill_missing_text(videos(spark, sf)).select("video_id", "description", "tags")


def _squeeze(expr: str) -> str:
    return rf"regexp_replace(regexp_replace({expr}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query("clean_text_fields", with_tables(rf"""
SELECT doc_id, regexp_replace({_squeeze('title')}, '[^\pL\pM\pN_\s\-.,!?;:]', '', 'g') AS title,
  coalesce(nullif({_squeeze('description')}, ''), '{K.NO_DESCRIPTION}') AS description,
  regexp_replace({_squeeze('tags')}, '[^\pL\pM\pN_\s\-|,]', '', 'g') AS tags,
  {_squeeze('channel_title')} AS channel_title
FROM doc_videos""", "docs"))
def clean_text_fields(spark, sf):
    return clean.clean_text_fields(doc_videos(spark, sf)).select(
        "doc_id", "title", "description", "tags", "channel_title")


def messy(spark, sf):
    """Videos as an untyped source would deliver them."""
    seq, views = F.col("seq"), F.col("views").cast("string")
    dates = F.col("publish_date").cast("string")
    return videos(spark, sf).withColumns({
        "views": F.when(seq % 19 == 0, "n/a").when(seq % 23 == 0, F.concat(F.lit("-"), views)).otherwise(views),
        "category_id": F.when(seq % 10 == 0, "?").otherwise(F.col("category_id").cast("string")),
        "publish_date": F.when(seq % 10 == 3, "invalid_date").when(seq % 10 == 7, F.lit(None)).otherwise(dates),
    })


@query("clean_numeric_fields", videos_sql("""
SELECT video_id, CASE WHEN seq % 19 = 0 OR seq % 23 = 0 THEN 0 ELSE views END AS views,
  coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments,
  CAST(CASE WHEN seq % 10 = 0 THEN 1 ELSE least(category_id, 44) END AS INTEGER) AS category_id
FROM videos"""))
def clean_numeric_fields(spark, sf):
    return clean.clean_numeric_fields(messy(spark, sf)).select(
        "video_id", "views", "likes", "comments", "category_id")


@query("fix_category_id", videos_sql("""
SELECT video_id, CAST(CASE WHEN category_id < 1 OR category_id > 44 THEN 1 ELSE category_id END AS INTEGER)
    AS category_reset,
  CAST(least(greatest(category_id, 1), 44) AS INTEGER) AS category_clip FROM videos"""))
def fix_category_id(spark, sf):
    df = videos(spark, sf).withColumn("original", F.col("category_id"))
    reset = clean.fix_category_id(df, "reset").withColumn("category_reset", F.col("category_id"))
    return clean.fix_category_id(reset.withColumn("category_id", F.col("original")), "clip").select(
        "video_id", "category_reset", F.col("category_id").alias("category_clip"))


@query("clean_date_fields", videos_sql(f"""
SELECT video_id,
  CASE WHEN seq % 10 IN (3, 7) THEN TIMESTAMP '{K.DEFAULT_PUBLISH_DATE}' ELSE publish_date END AS publish_date,
  coalesce(trending_date, TIMESTAMP '{NOW}') AS trending_date FROM videos"""))
def clean_date_fields(spark, sf):
    return clean.clean_date_fields(messy(spark, sf), F.lit(NOW)).select(
        "video_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("publish_date", "trending_date")])


def _fences(source: str, reach: float = 1.5) -> str:
    cells = ", ".join(
        f"{q1} - {reach} * ({q3} - {q1}) AS {c}_low, {q3} + {reach} * ({q3} - {q1}) AS {c}_high"
        for c in clean.CAPPED
        for q1, q3 in [(f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)")])
    return f"fences AS (SELECT {cells} FROM {source})"


def _capped(c: str) -> str:
    return f"CASE WHEN {c} < {c}_low THEN {c}_low WHEN {c} > {c}_high THEN {c}_high ELSE {c} END AS {c}"


@query("cap_outliers_iqr", videos_sql(
    f"SELECT video_id, {', '.join(_capped(c) for c in clean.CAPPED)} FROM videos, fences", _fences("videos")),
       doubles="views likes comments")
def cap_outliers_iqr(spark, sf):
    return clean.cap_outliers_iqr(videos(spark, sf)).select("video_id", *clean.CAPPED)


# The repaired rows, before capping.
_REPAIRED = f"""unique_rows AS ({survivors('trending')}),
numbers AS (
  SELECT * REPLACE (greatest(coalesce(views, 0), 0) AS views, greatest(coalesce(likes, 0), 0) AS likes,
    greatest(coalesce(comments, 0), 0) AS comments,
    CAST(least(greatest(coalesce(category_id, 0), 1), 44) AS INTEGER) AS category_id) FROM unique_rows),
{_fences('numbers')}"""


@query("comprehensive_clean", with_tables(rf"""
SELECT *, {RATE} AS engagement_rate, {band(RATE, *K.ENGAGEMENT_BANDS, closed='<=')} AS engagement_category,
  {band('views', *K.VIEW_BANDS, closed='<=')} AS view_category,
  CAST(length(title) AS INTEGER) AS title_length, CAST(len({words('title')}) AS INTEGER) AS title_word_count,
  CAST(length(description) AS INTEGER) AS description_length,
  CAST({tag_count('tags', '[|]')} AS INTEGER) AS tag_count, {tag_count('tags', '[|]')} > 0 AS has_tags,
  description <> '{K.NO_DESCRIPTION}' AS has_description,
  {hours('publish_date', 'trending_date')} AS time_to_trending_hours
FROM (SELECT video_id, title, category_id, channel_title, region_code, publish_date,
    coalesce(nullif({_squeeze("coalesce(description, '')")}, ''), '{K.NO_DESCRIPTION}') AS description,
    regexp_replace(coalesce(tags, ''), '[^\pL\pN_\s\-|,]', '', 'g') AS tags,
    coalesce(trending_date, TIMESTAMP '{NOW}') AS trending_date, {', '.join(_capped(c) for c in clean.CAPPED)}
  FROM numbers, fences)""", "trending", _REPAIRED),
       doubles="views likes comments engagement_rate time_to_trending_hours")
def comprehensive_clean(spark, sf):
    out = clean.comprehensive_clean(trending(spark, sf), TRENDING_ORDER, F.lit(NOW))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("publish_date", "trending_date")})


_OUTSIDE = " + ".join(f"CAST({c} < {c}_low OR {c} > {c}_high AS INTEGER)" for c in clean.CAPPED)


@query("cleaning_report", with_tables(f"""
SELECT *, round(greatest(0.0, 100.0 - (duplicates_removed + nulls_removed + invalid_values_corrected
    + outliers_handled) * 100.0 / initial_records), 2) AS data_quality_score
FROM (SELECT (SELECT count(*) FROM trending) AS initial_records,
  (SELECT count(*) FROM unique_rows WHERE video_id IS NOT NULL) AS final_records,
  (SELECT count(*) FROM trending) - (SELECT count(*) FROM unique_rows) AS duplicates_removed,
  (SELECT count(*) FROM unique_rows WHERE video_id IS NULL) AS nulls_removed,
  (SELECT CAST(count(*) FILTER (views < 0) + count(*) FILTER (likes < 0) + count(*) FILTER (comments < 0)
     + count(*) FILTER (coalesce(category_id, 0) NOT BETWEEN 1 AND 44) AS BIGINT) FROM unique_rows)
     AS invalid_values_corrected,
  (SELECT CAST(sum({_OUTSIDE}) AS BIGINT) FROM numbers, fences) AS outliers_handled)""",
    "trending", _REPAIRED), doubles="data_quality_score:2")
def cleaning_report(spark, sf):
    return clean.cleaning_report(trending(spark, sf), TRENDING_ORDER)


_BATCH = f"""unique_rows AS ({survivors('trending', 'views IS NOT NULL AND likes IS NOT NULL')}),
batch AS (
  SELECT video_id, regexp_replace(title, '\\s+', ' ', 'g') AS title,
    regexp_replace(coalesce(nullif(description, ''), '{K.NO_DESCRIPTION}'), '\\s+', ' ', 'g') AS description,
    coalesce(tags, '') AS tags,
    CAST(CASE WHEN category_id < 1 OR category_id > 44 THEN 1 ELSE category_id END AS INTEGER) AS category_id,
    channel_title, publish_date, trending_date, region_code, views, likes, coalesce(comments, 0) AS comments
  FROM unique_rows)"""


@query("glue_clean", with_tables("SELECT * FROM batch", "trending", _BATCH))
def glue_clean(spark, sf):
    """The batch job's cleaning sequence."""
    return clean.batch_clean(trending(spark, sf), TRENDING_ORDER)


BATCH_TABLE_SQL = with_tables(f"""
SELECT *, {RATE} AS engagement_rate, {band(RATE, *K.ENGAGEMENT_BANDS)} AS engagement_category,
  {band('views', *K.VIEW_BANDS)} AS view_category,
  date_diff('day', CAST(publish_date AS DATE), CAST(trending_date AS DATE)) * 24.0 AS time_to_trending_hours,
  CAST(hour(publish_date) AS INTEGER) AS publish_hour, CAST(dayofweek(publish_date) + 1 AS INTEGER) AS publish_day_of_week,
  CAST(week(publish_date) AS INTEGER) AS publish_week, CAST(month(publish_date) AS INTEGER) AS publish_month,
  CAST(year(publish_date) AS INTEGER) AS publish_year,
  CAST(length(title) AS INTEGER) AS title_length, CAST(len({words('title')}) AS INTEGER) AS title_word_count,
  CAST(length(description) AS INTEGER) AS description_length,
  CAST({tag_count('tags', '[|,]')} AS INTEGER) AS tag_count, {tag_count('tags')} > 0 AS has_tags,
  description <> '{K.NO_DESCRIPTION}' AS has_description
FROM batch""", "trending", _BATCH)


@query("batch_transform", BATCH_TABLE_SQL, doubles="engagement_rate time_to_trending_hours")
def batch_transform(spark, sf):
    """The batch job's cleaning and derived columns, without its files."""
    return clean.batch_transform(clean.batch_clean(trending(spark, sf), TRENDING_ORDER))


@query("apply_dashboard_filters", enriched_sql("""
SELECT video_id, publish_date, category_id, region_code, views, engagement_rate FROM enriched
WHERE category_id IN (1, 10, 20, 24) AND region_code IN ('US', 'GB') AND views BETWEEN 100000 AND 10000000
  AND engagement_rate BETWEEN 0 AND 0.1
  AND publish_date >= (SELECT max(publish_date) FROM enriched
    WHERE category_id IN (1, 10, 20, 24) AND region_code IN ('US', 'GB') AND views BETWEEN 100000 AND 10000000
      AND engagement_rate BETWEEN 0 AND 0.1) - INTERVAL 365 DAY"""), doubles="engagement_rate")
def apply_dashboard_filters(spark, sf):
    return filters.apply_dashboard_filters(
        enriched(spark, sf), days=365, categories=[1, 10, 20, 24], regions=["US", "GB"],
        views=(100_000, 10_000_000), engagement=(0, 0.1),
    ).select("video_id", "publish_date", "category_id", "region_code", "views", "engagement_rate")


@query("enrich_with_category", videos_sql(f"""
SELECT video_id, category_id, views, {titles('category_id', 'NULL')} AS category_title FROM videos"""))
def enrich_with_category(spark, sf):
    dim = joins.category_dimension(spark)
    return joins.enrich_with_category(videos(spark, sf), dim).select(
        "video_id", "category_id", "views", "category_title")


@query("enrich_with_category_inner", videos_sql(f"""
SELECT * FROM (SELECT video_id, category_id, views, {titles('category_id', 'NULL')} AS category_title FROM videos)
WHERE category_title IS NOT NULL"""))
def enrich_with_category_inner(spark, sf):
    dim = joins.category_dimension(spark)
    return joins.enrich_with_category(videos(spark, sf), dim, "inner").select(
        "video_id", "category_id", "views", "category_title")


@query("category_name_lookup", videos_sql(f"""
SELECT video_id, {titles('category_id', "'Other'")} AS view_name, {titles('category_id', "'Unknown'")} AS model_name,
  {titles('category_id', "'Category ' || category_id")} AS dashboard_name,
  {titles('category_id', 'NULL')} AS loader_name FROM videos"""))
def category_name_lookup(spark, sf):
    category = F.col("category_id")
    named = joins.category_name_lookup(videos(spark, sf), joins.category_dimension(spark), "Other")
    return named.select(
        "video_id", F.col("category_name").alias("view_name"),
        enrich.category_name(category).alias("model_name"),
        enrich.category_name(category, F.concat_ws(" ", F.lit("Category"), category)).alias("dashboard_name"),
        enrich.category_name(category, None).alias("loader_name"))


@query("align_predictions", enriched_sql("""
SELECT video_id, views, CAST(coalesce(nlp_predicted_category, -1) AS INTEGER) AS nlp_predicted_category,
  coalesce(nlp_category_confidence, 0.0) AS nlp_category_confidence, ml_predicted_views FROM enriched"""),
       doubles="nlp_category_confidence ml_predicted_views")
def align_predictions(spark, sf):
    names = ["nlp_predicted_category", "nlp_category_confidence", "ml_predicted_views"]
    scores = scored(spark, sf).where("ml_predicted_views IS NOT NULL").select("video_id", *names)
    return joins.align_predictions(
        videos(spark, sf).select("video_id", "views"), scores,
        {"nlp_predicted_category": -1, "nlp_category_confidence": 0.0, "ml_predicted_views": None})


HOURLY_SQL = enriched_sql("""
SELECT CAST(h AS INTEGER) AS publish_hour, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS label,
  coalesce(engagement, 0) AS engagement
FROM range(24) AS slots(h)
LEFT JOIN (SELECT publish_hour, avg(engagement_rate) * 100 AS engagement FROM enriched GROUP BY 1)
  ON publish_hour = h""")


@query("dense_hour_join", HOURLY_SQL, doubles="engagement")
def dense_hour_join(spark, sf):
    by_hour = enriched(spark, sf).groupBy("publish_hour").agg(metrics.percent_rate().alias("engagement"))
    return joins.dense_hour_join(by_hour, "publish_hour", "engagement")
