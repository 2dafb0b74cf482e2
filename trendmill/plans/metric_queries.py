"""G*, W*, O*: dashboard and audience figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import event_videos, videos
from trendmill.operators import audience, metrics
from trendmill.plans.clean_queries import HOURLY_SQL
from trendmill.plans.column_queries import AUDIENCE_SQL, audience_sql
from trendmill.plans.registry import query
from trendmill.plans.sqltext import band, enriched_sql, q, titles, videos_sql, with_tables
from trendmill.plans.tables import enriched, scored


@query("dashboard_metrics", enriched_sql("""
SELECT count(*) AS total_videos, CAST(sum(views) AS BIGINT) AS total_views,
  avg(engagement_rate) * 100 AS avg_engagement, count(DISTINCT channel_title) AS unique_channels,
  count(DISTINCT category_id) AS unique_categories, count(DISTINCT region_code) AS unique_regions,
  CAST(min(publish_date) AS DATE) AS start_date, CAST(max(publish_date) AS DATE) AS end_date
FROM enriched"""), doubles="avg_engagement")
def dashboard_metrics(spark, sf):
    return metrics.dashboard_metrics(enriched(spark, sf))


@query("daily_views_trend", with_tables("""
SELECT CAST(publish_date AS DATE) AS date, CAST(sum(views) AS BIGINT) AS views FROM event_videos
WHERE publish_date >= (SELECT max(publish_date) FROM event_videos) - INTERVAL 30 DAY GROUP BY 1""", "events"))
def daily_views_trend(spark, sf):
    return metrics.daily_views_trend(event_videos(spark, sf), days=30)


@query("category_performance", enriched_sql(f"""
SELECT category_id, {titles('category_id', "'Category ' || category_id")} AS category,
  CAST(sum(views) AS BIGINT) AS views, avg(engagement_rate) * 100 AS avg_engagement, count(video_id) AS count
FROM enriched GROUP BY category_id"""), doubles="avg_engagement")
def category_performance(spark, sf):
    return metrics.category_performance(enriched(spark, sf))


REGIONAL = videos_sql("""
SELECT region_code, CAST(sum(views) AS BIGINT) AS views,
  sum(views) * 100.0 / (SELECT sum(views) FROM videos) AS share_pct FROM videos GROUP BY region_code""")


@query("regional_distribution", REGIONAL, doubles="share_pct")
def regional_distribution(spark, sf):
    return metrics.regional_distribution(videos(spark, sf))


@query("share_of_total", videos_sql("""
SELECT category_id, region_code, count(*) AS videos,
  count(*) * 100.0 / (SELECT count(*) FROM videos) AS share_pct
FROM videos GROUP BY category_id, region_code"""), doubles="share_pct")
def share_of_total(spark, sf):
    cells = videos(spark, sf).groupBy("category_id", "region_code").agg(F.count("*").alias("videos"))
    return metrics.share_of_total(cells, "videos")


@query("hourly_engagement", HOURLY_SQL, doubles="engagement")
def hourly_engagement(spark, sf):
    return metrics.hourly_engagement(enriched(spark, sf))


def _top(limit: int) -> str:
    return enriched_sql(f"""
SELECT channel_title AS channel, CAST(sum(views) AS BIGINT) AS total_views,
  round(avg(engagement_rate) * 100, 2) AS avg_engagement, count(video_id) AS count
FROM enriched GROUP BY 1 ORDER BY total_views DESC, channel LIMIT {limit}""")


@query("top_channels", _top(10), doubles="avg_engagement:2")
def top_channels(spark, sf):
    return metrics.top_channels(enriched(spark, sf))


@query("channel_leaderboard", _top(20), doubles="avg_engagement:2")
def channel_leaderboard(spark, sf):
    return metrics.top_channels(enriched(spark, sf), limit=20)


@query("scatter_sample", enriched_sql("""
SELECT video_id, views AS x, engagement_rate * 100 AS y, title, category_id AS category
FROM enriched ORDER BY md5(video_id || '#42'), video_id LIMIT 100"""), doubles="y")
def scatter_sample(spark, sf):
    return metrics.scatter_sample(enriched(spark, sf))


@query("data_summary", enriched_sql("""
SELECT count(*) AS total_videos, count(DISTINCT channel_title) AS unique_channels,
  (SELECT string_agg(DISTINCT region_code, ',' ORDER BY region_code) FROM enriched) AS regions,
  min(publish_date) AS start_date, max(publish_date) AS end_date,
  CAST(sum(views) AS BIGINT) AS total_views, avg(views) AS avg_views, max(views) AS max_views,
  CAST(sum(likes) AS BIGINT) AS total_likes, avg(likes) AS avg_likes,
  CAST(sum(comments) AS BIGINT) AS total_comments, avg(comments) AS avg_comments,
  avg(engagement_rate) AS avg_engagement_rate,
  (SELECT string_agg(category_id || '=' || n, ',' ORDER BY category_id)
   FROM (SELECT category_id, count(*) AS n FROM enriched GROUP BY 1)) AS categories
FROM enriched"""), doubles="avg_views avg_likes avg_comments avg_engagement_rate")
def data_summary(spark, sf):
    """Region list and category map spelled out as text, so that SQL can say them too."""
    pairs = F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return metrics.data_summary(enriched(spark, sf)).withColumns({
        "regions": F.concat_ws(",", "regions"), "categories": F.concat_ws(",", pairs)})


@query("category_value_counts", videos_sql(
    "SELECT category_id, count(*) AS videos FROM videos GROUP BY category_id"))
def category_value_counts(spark, sf):
    return videos(spark, sf).groupBy("category_id").agg(F.count("*").alias("videos"))


@query("publishing_heatmap", enriched_sql("""
SELECT publish_hour, CAST(dayofweek(publish_date) + 1 AS INTEGER) AS day_of_week,
  avg(engagement_rate) AS avg_engagement_rate, count(*) AS videos FROM enriched GROUP BY 1, 2"""),
       doubles="avg_engagement_rate")
def publishing_heatmap(spark, sf):
    return metrics.publishing_heatmap(enriched(spark, sf))


@query("engagement_quadrants", enriched_sql("""
SELECT CASE WHEN views >= 100000 THEN 'High Views' ELSE 'Low Views' END || ' / ' ||
    CASE WHEN engagement_rate >= 0.05 THEN 'High Engagement' ELSE 'Low Engagement' END AS quadrant,
  count(*) AS videos, CAST(sum(likes) AS BIGINT) AS likes
FROM enriched WHERE views IS NOT NULL AND engagement_rate IS NOT NULL GROUP BY 1"""))
def engagement_quadrants(spark, sf):
    return metrics.engagement_quadrants(enriched(spark, sf))


@query("engagement_level_distribution", enriched_sql("""
SELECT engagement_category AS engagement_level, count(*) AS videos,
  count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM enriched WHERE engagement_category IS NOT NULL GROUP BY 1"""), doubles="share_pct")
def engagement_level_distribution(spark, sf):
    return metrics.engagement_level_distribution(enriched(spark, sf))


@query("engagement_box_by_tags", enriched_sql(f"""
SELECT bucket, q1, median, q3,
  min(rate) FILTER (rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(rate) FILTER (rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (rate NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS videos
FROM rows_by_bucket JOIN (SELECT bucket, quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.5) AS median,
    quantile_cont(rate, 0.75) AS q3 FROM rows_by_bucket GROUP BY bucket) USING (bucket)
GROUP BY bucket, q1, median, q3""",
    f"""rows_by_bucket AS (SELECT {band('tag_count', *metrics.TAG_BUCKETS)} AS bucket, engagement_rate AS rate
  FROM enriched WHERE engagement_rate IS NOT NULL)"""), doubles="q1 median q3 whisker_low whisker_high")
def engagement_box_by_tags(spark, sf):
    return metrics.engagement_box_by_tags(enriched(spark, sf))


def histogram_sql(value: str, bins: int, extra: str = "") -> str:
    return f"""
SELECT CAST(b AS INTEGER) AS bin, low + b * width AS bin_start, low + (b + 1) * width AS bin_end,
  coalesce(n, 0) AS count, mean, stddev{extra}
FROM range({bins}) AS slots(b)
CROSS JOIN (SELECT min({value}) AS low, (max({value}) - min({value})) / {bins}.0 AS width, avg({value}) AS mean,
    stddev_samp({value}) AS stddev FROM points)
LEFT JOIN (SELECT CAST(least(floor(({value} - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM points, (SELECT min({value}) AS lo, (max({value}) - min({value})) / {bins}.0 AS w FROM points)
  WHERE {value} IS NOT NULL GROUP BY 1) ON bin = b"""


@query("error_histogram", enriched_sql(
    histogram_sql("x", 20),
    "points AS (SELECT abs(views - ml_predicted_views) AS x FROM enriched WHERE ml_predicted_views IS NOT NULL)"),
       doubles="bin_start:3 bin_end:3 mean:3 stddev:3")
def error_histogram(spark, sf):
    return metrics.error_histogram(scored(spark, sf))


@query("views_and_engagement_histogram", enriched_sql(
    histogram_sql("x", 20, ", 'views' AS metric") + "\nUNION ALL\n"
    + histogram_sql("y", 20, ", 'engagement_rate' AS metric"),
    "points AS (SELECT CAST(views AS DOUBLE) AS x, engagement_rate AS y FROM enriched)"),
       doubles="bin_start:3 bin_end:3 mean:3 stddev:3")
def views_and_engagement_histogram(spark, sf):
    return metrics.views_and_engagement_histogram(enriched(spark, sf))


_CARD = """count(*) AS total_predictions, count(*) FILTER (nlp_predicted_category = category_id) AS correct_predictions,
  count(*) FILTER (nlp_predicted_category = category_id) * 1.0 / count(*) AS accuracy,
  avg(nlp_category_confidence) AS avg_confidence FROM enriched
WHERE nlp_predicted_category IS NOT NULL AND nlp_predicted_category <> -1"""


@query("nlp_scorecard", enriched_sql(f"SELECT {_CARD}"), doubles="accuracy avg_confidence")
def nlp_scorecard(spark, sf):
    return metrics.nlp_scorecard(scored(spark, sf))


@query("nlp_scorecard_by_category", enriched_sql(f"SELECT category_id, {_CARD} GROUP BY category_id"),
       doubles="accuracy avg_confidence")
def nlp_scorecard_by_category(spark, sf):
    return metrics.nlp_scorecard(scored(spark, sf), "category_id")


@query("trending_speed_funnel", enriched_sql(f"""
SELECT speed AS trending_speed, count(*) AS videos,
  CAST(list_position(['Very Fast', 'Fast', 'Medium', 'Slow'], speed) AS INTEGER) AS stage
FROM (SELECT {band('time_to_trending_hours', *K.SPEED_BANDS, closed='<=')} AS speed FROM enriched)
WHERE speed IS NOT NULL GROUP BY 1"""))
def trending_speed_funnel(spark, sf):
    return metrics.trending_speed_funnel(enriched(spark, sf))


@query("trending_calendar", videos_sql("""
SELECT CAST(trending_date AS DATE) AS date, count(*) AS videos,
  dayofweek(CAST(trending_date AS DATE)) IN (0, 6) AS is_weekend
FROM videos WHERE trending_date IS NOT NULL GROUP BY 1"""))
def trending_calendar(spark, sf):
    return metrics.trending_calendar(videos(spark, sf))


_LINE = "regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS points"
_DAILY = """daily AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(publish_date AS DATE)) AS DOUBLE) AS x,
  CAST(sum(views) AS DOUBLE) AS y FROM videos GROUP BY 1)"""


@query("trend_line", videos_sql(f"SELECT {_LINE} FROM daily", _DAILY), doubles="slope:3 intercept:1 r2")
def trend_line(spark, sf):
    return metrics.daily_views_line(videos(spark, sf))


@query("trend_line_engagement_views", enriched_sql(f"""
SELECT {_LINE} FROM (SELECT CAST(views AS DOUBLE) AS x, engagement_rate AS y FROM enriched
  WHERE engagement_rate IS NOT NULL)"""), doubles="slope:12 intercept r2")
def trend_line_engagement_views(spark, sf):
    return metrics.trend_line(enriched(spark, sf), F.col("views"), F.col("engagement_rate"))


@query("trend_line_engagement_title", enriched_sql(f"""
SELECT {_LINE} FROM (SELECT CAST(title_length AS DOUBLE) AS x, engagement_rate AS y FROM enriched
  WHERE engagement_rate IS NOT NULL)"""), doubles="slope:9 intercept r2")
def trend_line_engagement_title(spark, sf):
    return metrics.trend_line(enriched(spark, sf), F.col("title_length"), F.col("engagement_rate"))


@query("views_forecast", videos_sql("""
SELECT last + CAST(step AS INTEGER) AS date,
  intercept + slope * date_diff('day', DATE '1970-01-01', last + CAST(step AS INTEGER)) AS forecast_views
FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
    (SELECT CAST(max(publish_date) AS DATE) FROM videos) AS last FROM daily), range(1, 31) AS steps(step)""", _DAILY),
       doubles="forecast_views:1")
def views_forecast(spark, sf):
    return metrics.views_forecast(videos(spark, sf))


@query("lod_fixed_metrics", enriched_sql("""
SELECT video_id, category_id, channel_title, CAST(publish_date AS DATE) AS publish_day,
  CAST(sum(views) OVER (PARTITION BY CAST(publish_date AS DATE)) AS BIGINT) AS daily_views,
  avg(engagement_rate) OVER (PARTITION BY channel_title) AS channel_avg_engagement,
  median(views) OVER (PARTITION BY category_id) AS category_median_views FROM enriched"""),
       doubles="channel_avg_engagement category_median_views")
def lod_fixed_metrics(spark, sf):
    return metrics.lod_fixed_metrics(enriched(spark, sf)).select(
        "video_id", "category_id", "channel_title", "publish_day", "daily_views", "channel_avg_engagement",
        "category_median_views")


@query("actual_vs_predicted", enriched_sql(f"""
SELECT video_id, views AS actual_views, ml_predicted_views AS predicted_views,
  views - ml_predicted_views AS residual, abs(views - ml_predicted_views) AS views_prediction_error,
  {band('abs(views - ml_predicted_views) / views', *K.ERROR_BANDS, closed='<=')} AS views_prediction_quality
FROM enriched WHERE ml_predicted_views IS NOT NULL"""),
       doubles="predicted_views residual views_prediction_error")
def actual_vs_predicted(spark, sf):
    return metrics.actual_vs_predicted(scored(spark, sf))


@query("best_publishing_hours", enriched_sql("""
SELECT publish_hour, avg(engagement_rate) AS avg_engagement_rate, count(*) AS videos
FROM enriched WHERE engagement_rate IS NOT NULL GROUP BY 1
ORDER BY avg(engagement_rate) DESC, publish_hour LIMIT 3"""), doubles="avg_engagement_rate")
def best_publishing_hours(spark, sf):
    return metrics.best_publishing_hours(enriched(spark, sf))


def _period(unit: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', publish_date) AS DATE) AS period_start, '{unit}' AS period,
  count(*) AS videos, CAST(sum(views) AS BIGINT) AS total_views, avg(engagement_rate) AS avg_engagement_rate
FROM enriched GROUP BY 1"""


@query("seasonal_trend", enriched_sql(_period("month") + " UNION ALL " + _period("quarter")),
       doubles="avg_engagement_rate")
def seasonal_trend(spark, sf):
    return metrics.seasonal_trend(enriched(spark, sf))


@query("kpi_monitor", enriched_sql("""
SELECT count(*) AS videos, count(*) FILTER (views > 1000000) AS viral_videos,
  count(*) FILTER (views > 1000000) * 1.0 / count(*) AS viral_share,
  count(*) FILTER (engagement_rate > 0.05) AS high_engagement_videos,
  count(*) FILTER (engagement_rate > 0.05) * 1.0 / count(*) AS high_engagement_share,
  count(*) FILTER (time_to_trending_hours < 24) AS fast_trending_videos,
  count(*) FILTER (time_to_trending_hours < 24) * 1.0 / count(time_to_trending_hours) AS fast_trending_share,
  count(*) FILTER (nlp_predicted_category = category_id) * 1.0 / count(nlp_predicted_category) AS nlp_accuracy,
  count(*) FILTER (nlp_predicted_category = category_id) * 1.0 / count(nlp_predicted_category) > 0.85 AS nlp_accuracy_ok,
  count(*) FILTER (abs(views - ml_predicted_views) / views < 0.2) AS close_predictions,
  count(*) FILTER (abs(views - ml_predicted_views) / views < 0.2) * 1.0 / count(ml_predicted_views)
    AS close_prediction_share FROM enriched"""),
       doubles="viral_share high_engagement_share fast_trending_share nlp_accuracy close_prediction_share")
def kpi_monitor(spark, sf):
    return metrics.kpi_monitor(scored(spark, sf))


def people(spark, sf):
    return audience.audience_table(videos(spark, sf))


@query("age_distribution", audience_sql("""
SELECT age_group, count(*) AS videos, count(*) * 100.0 / sum(count(*)) OVER () AS percentage
FROM audience GROUP BY 1"""), doubles="percentage")
def age_distribution(spark, sf):
    return audience.age_distribution(people(spark, sf))


@query("age_metric_means", audience_sql("""
SELECT age_group, avg(engagement_rate) AS avg_engagement_rate, avg(views) AS avg_views,
  avg(publish_hour) AS avg_publish_hour, avg(title_length) AS avg_title_length,
  avg(tag_count) AS avg_tag_count, avg(duration) AS avg_duration, avg(publish_is_weekend) AS weekend_share
FROM audience GROUP BY 1"""),
       doubles="avg_engagement_rate avg_views avg_publish_hour avg_title_length avg_tag_count avg_duration "
               "weekend_share")
def age_metric_means(spark, sf):
    return audience.age_metric_means(people(spark, sf))


@query("age_category_counts", audience_sql("""
SELECT age_group, string_agg(category_id || '=' || n, ',' ORDER BY category_id) AS category_counts
FROM (SELECT age_group, category_id, count(*) AS n FROM audience GROUP BY 1, 2) GROUP BY 1"""))
def age_category_counts(spark, sf):
    """The per-group map, spelled out as text for the comparison."""
    pairs = F.transform(F.map_entries("category_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return audience.age_category_counts(people(spark, sf)).select(
        "age_group", F.concat_ws(",", pairs).alias("category_counts"))


@query("top_category_per_group", audience_sql("""
SELECT age_group, category_id AS top_category, n AS top_count FROM (
  SELECT age_group, category_id, count(*) AS n,
    row_number() OVER (PARTITION BY age_group ORDER BY count(*) DESC, category_id) AS place
  FROM audience GROUP BY 1, 2) WHERE place = 1"""))
def top_category_per_group(spark, sf):
    return audience.top_category_per_group(people(spark, sf))


_LEVEL = "CASE age_group_id " + " ".join(f"WHEN {g} THEN {q(row[3])}" for g, row in K.AGE_GROUPS.items()) + " END"


@query("age_complexity_counts", audience_sql(f"""
SELECT age_group, count(*) FILTER (level = 'Simple') AS "Simple",
  count(*) FILTER (level = 'Moderate') AS "Moderate", count(*) FILTER (level = 'Advanced') AS "Advanced"
FROM (SELECT age_group, {_LEVEL} AS level FROM audience) GROUP BY 1"""))
def age_complexity_counts(spark, sf):
    return audience.age_complexity_counts(audience.age_bounds_lookup(people(spark, sf)))


@query("age_hour_heatmap", audience_sql(
    "SELECT age_group, " + ", ".join(f"count(*) FILTER (publish_hour = {h}) AS h{h:02d}" for h in range(24))
    + " FROM audience GROUP BY 1"))
def age_hour_heatmap(spark, sf):
    return audience.age_hour_heatmap(people(spark, sf))


_MEANS = """means AS (SELECT age_group, avg(engagement_rate) AS e, avg(views) AS v, avg(title_length) AS t,
  avg(publish_hour) AS h FROM audience GROUP BY 1)"""


def _leader(name: str, column: str) -> str:
    return (f"(SELECT '{name}' AS insight, age_group, CAST(NULL AS VARCHAR) AS label, {column} AS value "
            f"FROM means ORDER BY {column} DESC, age_group LIMIT 1)")


@query("age_insights", enriched_sql(
    " UNION ALL ".join([_leader("most_engaged", "e"), _leader("most_viewed", "v"), _leader("longest_titles", "t"),
                        """SELECT 'peak_time', age_group, CASE WHEN floor(h) BETWEEN 6 AND 11 THEN 'Morning'
  WHEN floor(h) BETWEEN 12 AND 17 THEN 'Afternoon' WHEN floor(h) BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Night' END,
  floor(h) FROM means"""]), AUDIENCE_SQL.strip(), _MEANS),
       doubles="value")
def age_insights(spark, sf):
    return audience.age_insights(people(spark, sf))
