"""V*: the dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.operators import views
from trendmill.plans.registry import query
from trendmill.plans.sqltext import band, enriched_sql, part_of_day, titles
from trendmill.plans.tables import enriched, scored

AS_OF = "2002-01-01"


def common(prefix: str = "", whole: str = "total") -> str:
    sums = ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {prefix}{whole}_{c}, avg({c}) AS {prefix}avg_{c}"
        + (f", max(views) AS {prefix}max_views" if c == "views" else "")
        for c in ("views", "likes", "comments"))
    return (f"count(*) AS {prefix}video_count, {sums}, "
            f"avg(engagement_rate) AS {prefix}avg_engagement_rate")


MEANS = "avg_views avg_likes avg_comments avg_engagement_rate"

OVERVIEW = enriched_sql("""
SELECT video_id, title, channel_title, category_id, region_code, views, likes, comments,
  engagement_rate, view_category, engagement_category, publish_date, trending_date,
  CAST(floor((epoch_us(trending_date) - epoch_us(publish_date)) / 86400000000.0) AS BIGINT) AS days_to_trending,
  title_length, description_length, tag_count, extracted_at
FROM enriched WHERE views > 0""")


@query("video_performance_overview", OVERVIEW, doubles="engagement_rate")
def video_performance_overview(spark, sf):
    return views.video_performance_overview(enriched(spark, sf))


@query("global_sort", OVERVIEW, doubles="engagement_rate")
def global_sort(spark, sf):
    """The overview in its ORDER BY: views, largest first."""
    return views.in_view_order(views.video_performance_overview(enriched(spark, sf)), "views")


@query("category_analysis", enriched_sql(f"""
SELECT category_id, {titles('category_id', "'Other'")} AS category_name, {common()},
  count(DISTINCT channel_title) AS unique_channels, count(DISTINCT region_code) AS regions_covered
FROM enriched WHERE category_id IS NOT NULL GROUP BY category_id"""), doubles=MEANS)
def category_analysis(spark, sf):
    return views.category_analysis(enriched(spark, sf))


@query("regional_analysis", enriched_sql(f"""
SELECT region_code, {common()}, count(DISTINCT category_id) AS unique_categories,
  count(DISTINCT channel_title) AS unique_channels,
  CAST(date_trunc('month', publish_date) AS DATE) AS publish_month,
  CAST(date_trunc('month', trending_date) AS DATE) AS trending_month
FROM enriched WHERE region_code IS NOT NULL GROUP BY ALL"""), doubles=MEANS)
def regional_analysis(spark, sf):
    return views.regional_analysis(enriched(spark, sf))


@query("time_series_analysis", enriched_sql(f"""
SELECT CAST(publish_date AS DATE) AS publish_date, CAST(trending_date AS DATE) AS trending_date,
  {common('daily_')}, count(DISTINCT region_code) AS daily_regions,
  count(DISTINCT category_id) AS daily_categories
FROM enriched WHERE publish_date IS NOT NULL GROUP BY 1, 2"""),
       doubles=" ".join(f"daily_{c}" for c in MEANS.split()))
def time_series_analysis(spark, sf):
    return views.time_series_analysis(enriched(spark, sf))


@query("channel_performance", enriched_sql(f"""
SELECT channel_title, {common()}, count(DISTINCT category_id) AS unique_categories,
  count(DISTINCT region_code) AS unique_regions, min(publish_date) AS first_video_date,
  max(publish_date) AS last_video_date,
  CAST(date_diff('day', min(publish_date), max(publish_date)) AS INTEGER) AS active_days
FROM enriched WHERE channel_title IS NOT NULL GROUP BY channel_title HAVING count(*) >= 5"""), doubles=MEANS)
def channel_performance(spark, sf):
    return views.channel_performance(enriched(spark, sf))


@query("engagement_analysis", enriched_sql(f"""
SELECT video_id, title, channel_title, views, likes, comments, engagement_rate, like_rate, comment_rate,
  like_to_comment_ratio, title_length, description_length, tag_count,
  CASE WHEN engagement_rate >= 0.05 THEN 'High' WHEN engagement_rate >= 0.01 THEN 'Medium' ELSE 'Low' END
    AS engagement_level,
  title_word_count, has_description, has_tags, publish_hour,
  {part_of_day('publish_hour')} AS publish_time_of_day, is_weekend, is_business_hours, is_prime_time
FROM enriched WHERE views > 0 AND engagement_rate IS NOT NULL"""),
       doubles="engagement_rate like_rate comment_rate like_to_comment_ratio")
def engagement_analysis(spark, sf):
    return views.engagement_analysis(enriched(spark, sf))


@query("trending_analysis", enriched_sql(f"""
SELECT video_id, title, channel_title, category_id, region_code, views, likes, comments, publish_date,
  trending_date, CAST(hour(trending_date) AS INTEGER) AS trending_hour,
  CAST(dayofweek(trending_date) + 1 AS INTEGER) AS trending_day_of_week, time_to_trending_hours,
  {band('time_to_trending_hours', *K.SPEED_BANDS, closed='<=')} AS trending_speed,
  CASE WHEN dayofweek(trending_date) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS trending_day_type
FROM enriched WHERE time_to_trending_hours IS NOT NULL"""), doubles="time_to_trending_hours")
def trending_analysis(spark, sf):
    return views.trending_analysis(enriched(spark, sf))


@query("ml_predictions_analysis", enriched_sql(f"""
SELECT video_id, title, views, likes, comments, engagement_rate, ml_predicted_engagement_rate,
  abs(engagement_rate - ml_predicted_engagement_rate) AS engagement_prediction_error,
  ml_predicted_views, abs(views - ml_predicted_views) AS views_prediction_error,
  {band('abs(views - ml_predicted_views) / views', *K.ERROR_BANDS, closed='<=')} AS views_prediction_quality,
  CAST(nlp_predicted_category AS INTEGER) AS nlp_predicted_category, category_id AS actual_category,
  CASE WHEN nlp_predicted_category = category_id THEN 'Correct' ELSE 'Incorrect' END AS nlp_prediction_correct,
  nlp_category_confidence, title_length, description_length, tag_count
FROM enriched WHERE ml_predicted_views IS NOT NULL AND nlp_predicted_category IS NOT NULL"""),
       doubles="engagement_rate ml_predicted_engagement_rate engagement_prediction_error "
               "nlp_category_confidence ml_predicted_views views_prediction_error")
def ml_predictions_analysis(spark, sf):
    """Scores have nine digits, so ties of the sixth occur; like the twin, they are scaled before they are rounded."""
    return views.ml_predictions_analysis(scored(spark, sf)).withColumns({
        c: F.round(F.col(c) * 1e6) / 1e6 for c in ("ml_predicted_engagement_rate", "nlp_category_confidence")})


@query("dashboard_summary", enriched_sql(f"""
SELECT count(*) AS total_videos, count(DISTINCT video_id) AS unique_videos,
  {common().split(', ', 1)[1]}, count(DISTINCT category_id) AS unique_categories,
  count(DISTINCT channel_title) AS unique_channels, count(DISTINCT region_code) AS unique_regions,
  min(publish_date) AS earliest_publish_date, max(publish_date) AS latest_publish_date,
  min(trending_date) AS earliest_trending_date, max(trending_date) AS latest_trending_date,
  count(*) FILTER (views < 10000) AS low_view_videos,
  count(*) FILTER (views >= 10000 AND views < 100000) AS medium_view_videos,
  count(*) FILTER (views >= 100000 AND views < 1000000) AS high_view_videos,
  count(*) FILTER (views >= 1000000) AS viral_videos,
  count(*) FILTER (engagement_rate < 0.01) AS low_engagement_videos,
  count(*) FILTER (engagement_rate >= 0.01 AND engagement_rate < 0.05) AS medium_engagement_videos,
  count(*) FILTER (engagement_rate >= 0.05) AS high_engagement_videos,
  count(DISTINCT video_id) FILTER (nlp_predicted_category = category_id) AS correct_nlp_predictions,
  count(DISTINCT video_id) FILTER (nlp_predicted_category IS NOT NULL) AS total_nlp_predictions,
  avg(abs(views - ml_predicted_views) / views) AS avg_ml_error_rate,
  CAST(date_diff('day', CAST(max(publish_date) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last_video,
  CAST(date_diff('day', CAST(max(trending_date) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last_trending
FROM enriched WHERE views > 0"""), doubles=MEANS + " avg_ml_error_rate")
def dashboard_summary(spark, sf):
    return views.dashboard_summary(scored(spark, sf), as_of=AS_OF)


@query("high_performance_videos", enriched_sql("""
SELECT video_id, title, channel_title, views, likes, comments, engagement_rate, category_id,
  publish_date, trending_date
FROM enriched WHERE views > 1000000 OR engagement_rate > 0.05"""), doubles="engagement_rate")
def high_performance_videos(spark, sf):
    return views.high_performance_videos(enriched(spark, sf))


@query("viral_content_analysis", enriched_sql("""
SELECT category_id, count(*) AS video_count, CAST(sum(views) AS BIGINT) AS total_views,
  avg(views) AS avg_views, count(*) FILTER (views > 1000000) AS viral_count,
  count(*) FILTER (views > 1000000) * 100.0 / count(*) AS viral_percentage
FROM enriched GROUP BY category_id"""), doubles="avg_views viral_percentage")
def viral_content_analysis(spark, sf):
    return views.viral_content_analysis(enriched(spark, sf))
