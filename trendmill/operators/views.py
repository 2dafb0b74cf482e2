"""The dashboard views, as functions of the analytics table.

Bodies carry no ORDER BY; ``in_view_order`` sorts at the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.functions import bands
from trendmill.operators.enrich import category_name
from trendmill.session import materialise

def in_view_order(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Range-partitioned total order, applied to what is handed out."""
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def traffic(prefix: str = "", whole: str = "total") -> list:
    """Count, sums, means and the maximum every grouped view reports."""
    out = [F.count("*").alias(f"{prefix}video_count")]
    for column in ("views", "likes", "comments"):
        out.append(F.sum(column).alias(f"{prefix}{whole}_{column}"))
        out.append(F.avg(column).alias(f"{prefix}avg_{column}"))
        if column == "views":
            out.append(F.max(column).alias(f"{prefix}max_views"))
    out.append(F.avg("engagement_rate").alias(f"{prefix}avg_engagement_rate"))
    return out


def video_performance_overview(df: DataFrame) -> DataFrame:
    return df.where("views > 0").select(
        "video_id", "title", "channel_title", "category_id", "region_code", "views", "likes",
        "comments", "engagement_rate", "view_category", "engagement_category", "publish_date",
        "trending_date",
        F.floor(
            (F.unix_micros(F.col("trending_date").cast("timestamp"))
             - F.unix_micros(F.col("publish_date").cast("timestamp"))) / 86_400_000_000
        ).cast("long").alias("days_to_trending"),
        "title_length", "description_length", "tag_count", "extracted_at",
    )


def category_analysis(df: DataFrame) -> DataFrame:
    grouped = df.where("category_id IS NOT NULL").groupBy("category_id").agg(
        *traffic(),
        F.count_distinct("channel_title").alias("unique_channels"),
        F.count_distinct("region_code").alias("regions_covered"),
    )
    name = category_name(F.col("category_id"), "Other").alias("category_name")
    return grouped.select("category_id", name, *grouped.columns[1:])


def regional_analysis(df: DataFrame) -> DataFrame:
    grouped = (
        df.where("region_code IS NOT NULL")
        .groupBy("region_code",
                 F.date_trunc("month", "publish_date").cast("date").alias("publish_month"),
                 F.date_trunc("month", "trending_date").cast("date").alias("trending_month"))
        .agg(*traffic(),
             F.count_distinct("category_id").alias("unique_categories"),
             F.count_distinct("channel_title").alias("unique_channels"))
    )
    months = ["publish_month", "trending_month"]
    return grouped.select(*[c for c in grouped.columns if c not in months], *months)


def time_series_analysis(df: DataFrame) -> DataFrame:
    return (
        df.where("publish_date IS NOT NULL")
        .groupBy(F.to_date("publish_date").alias("publish_date"),
                 F.to_date("trending_date").alias("trending_date"))
        .agg(*traffic("daily_"),
             F.count_distinct("region_code").alias("daily_regions"),
             F.count_distinct("category_id").alias("daily_categories"))
    )


def channel_performance(df: DataFrame, min_videos: int = 5) -> DataFrame:
    return (
        df.where("channel_title IS NOT NULL")
        .groupBy("channel_title")
        .agg(*traffic(),
             F.count_distinct("category_id").alias("unique_categories"),
             F.count_distinct("region_code").alias("unique_regions"),
             F.min("publish_date").alias("first_video_date"),
             F.max("publish_date").alias("last_video_date"),
             F.date_diff(F.max("publish_date"), F.min("publish_date")).alias("active_days"))
        .where(F.col("video_count") >= min_videos)
    )


def engagement_analysis(df: DataFrame) -> DataFrame:
    return df.where("views > 0 AND engagement_rate IS NOT NULL").select(
        "video_id", "title", "channel_title", "views", "likes", "comments",
        "engagement_rate", "like_rate", "comment_rate", "like_to_comment_ratio",
        "title_length", "description_length", "tag_count",
        F.col("engagement_category").alias("engagement_level"),
        "title_word_count", "has_description", "has_tags", "publish_hour",
        bands.time_of_day(F.col("publish_hour")).alias("publish_time_of_day"),
        "is_weekend", "is_business_hours", "is_prime_time",
    )


def trending_analysis(df: DataFrame) -> DataFrame:
    day = F.dayofweek("trending_date")
    return df.where("time_to_trending_hours IS NOT NULL").select(
        "video_id", "title", "channel_title", "category_id", "region_code", "views", "likes",
        "comments", "publish_date", "trending_date",
        F.hour("trending_date").alias("trending_hour"),
        day.alias("trending_day_of_week"),
        "time_to_trending_hours",
        bands.trending_speed(F.col("time_to_trending_hours")).alias("trending_speed"),
        F.when(day.isin(1, 7), "Weekend").otherwise("Weekday").alias("trending_day_type"),
    )


def prediction_quality(df: DataFrame) -> DataFrame:
    """Absolute errors, relative-error band and NLP verdict; zero views give a null band."""
    error = F.abs(F.col("views") - F.col("ml_predicted_views"))
    return df.withColumns({
        "views_prediction_error": error,
        "engagement_prediction_error":
            F.abs(F.col("engagement_rate") - F.col("ml_predicted_engagement_rate")),
        "views_prediction_quality": bands.error_quality(F.try_divide(error, F.col("views"))),
        "nlp_prediction_correct":
            F.when(F.col("nlp_predicted_category") == F.col("category_id"), "Correct")
            .otherwise("Incorrect"),
    })


def ml_predictions_analysis(df: DataFrame) -> DataFrame:
    scored = df.where("ml_predicted_views IS NOT NULL AND nlp_predicted_category IS NOT NULL")
    return prediction_quality(scored).select(
        "video_id", "title", "views", "likes", "comments",
        "engagement_rate", "ml_predicted_engagement_rate", "engagement_prediction_error",
        "ml_predicted_views", "views_prediction_error", "views_prediction_quality",
        "nlp_predicted_category", F.col("category_id").alias("actual_category"),
        "nlp_prediction_correct", "nlp_category_confidence",
        "title_length", "description_length", "tag_count",
    )


def dashboard_summary(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row of totals.  ``as_of`` replaces today so that runs can be repeated."""
    views, rate, video = F.col("views"), F.col("engagement_rate"), F.col("video_id")
    predicted = F.col("nlp_predicted_category")
    today = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    error = F.try_divide(F.abs(views - F.col("ml_predicted_views")), views)
    rows = df.where("views > 0").select(
        video, "views", "likes", "comments", rate, "category_id", "channel_title", "region_code", "publish_date",
        "trending_date", "view_category", "engagement_category", predicted, error.alias("error"))
    rows = materialise(rows, "dashboard-rows")
    # Three distinct counts of one key are one row per key; as aggregates each of them would ship the key again.
    per_video = rows.where(video.isNotNull()).groupBy(video).agg(
        F.max(predicted.eqNullSafe(F.col("category_id")) & predicted.isNotNull()).alias("correct"),
        F.max(predicted.isNotNull()).alias("predicted"))
    counts = per_video.agg(
        F.count("*").alias("unique_videos"), F.count_if("correct").alias("correct_nlp_predictions"),
        F.count_if("predicted").alias("total_nlp_predictions"))
    totals = rows.agg(
        F.count("*").alias("total_videos"),
        *[a for a in traffic()[1:]],
        F.count_distinct("category_id").alias("unique_categories"),
        F.count_distinct("channel_title").alias("unique_channels"),
        F.count_distinct("region_code").alias("unique_regions"),
        F.min("publish_date").alias("earliest_publish_date"),
        F.max("publish_date").alias("latest_publish_date"),
        F.min("trending_date").alias("earliest_trending_date"),
        F.max("trending_date").alias("latest_trending_date"),
        F.count_if(F.col("view_category") == "Low").alias("low_view_videos"),
        F.count_if(F.col("view_category") == "Medium").alias("medium_view_videos"),
        F.count_if(F.col("view_category") == "High").alias("high_view_videos"),
        F.count_if(F.col("view_category") == "Viral").alias("viral_videos"),
        F.count_if(F.col("engagement_category") == "Low").alias("low_engagement_videos"),
        F.count_if(F.col("engagement_category") == "Medium").alias("medium_engagement_videos"),
        F.count_if(F.col("engagement_category") == "High").alias("high_engagement_videos"),
        F.avg("error").alias("avg_ml_error_rate"),
        F.date_diff(today, F.max("publish_date")).alias("days_since_last_video"),
        F.date_diff(today, F.max("trending_date")).alias("days_since_last_trending"),
    )
    names = totals.columns
    place = names.index("avg_ml_error_rate")
    return totals.crossJoin(counts).select(  # one row each
        "total_videos", "unique_videos", *names[1:place], "correct_nlp_predictions", "total_nlp_predictions", *names[place:])


def high_performance_videos(df: DataFrame, min_views: int = 1_000_000,
                            min_rate: float = 0.05) -> DataFrame:
    strong = (F.col("views") > min_views) | (F.col("engagement_rate") > min_rate)
    return df.where(strong).select(
        "video_id", "title", "channel_title", "views", "likes", "comments", "engagement_rate",
        "category_id", "publish_date", "trending_date")


def viral_content_analysis(df: DataFrame, min_views: int = 1_000_000) -> DataFrame:
    viral = F.count_if(F.col("views") > min_views)
    return df.groupBy("category_id").agg(
        F.count("*").alias("video_count"),
        F.sum("views").alias("total_views"),
        F.avg("views").alias("avg_views"),
        viral.alias("viral_count"),
        (viral * 100.0 / F.count("*")).alias("viral_percentage"))
