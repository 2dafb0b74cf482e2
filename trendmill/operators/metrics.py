"""Dashboard figures: aggregates over the analytics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendmill.functions import bands
from trendmill.operators.enrich import category_name
from trendmill.operators.filters import trailing_days
from trendmill.operators.joins import dense_hour_join
from trendmill.operators.ranks import exact_quantiles, null_safe_join
from trendmill.operators.views import prediction_quality

def percent_rate() -> Column:
    return F.avg("engagement_rate") * 100


def dashboard_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_videos"),
        F.sum("views").alias("total_views"),
        percent_rate().alias("avg_engagement"),
        F.count_distinct("channel_title").alias("unique_channels"),
        F.count_distinct("category_id").alias("unique_categories"),
        F.count_distinct("region_code").alias("unique_regions"),
        F.to_date(F.min("publish_date")).alias("start_date"),
        F.to_date(F.max("publish_date")).alias("end_date"))


def daily_views(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("publish_date").alias("date")).agg(F.sum("views").alias("views"))


def daily_views_trend(df: DataFrame, days: int = 30) -> DataFrame:
    return daily_views(trailing_days(df, days))


def category_performance(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("category_id").agg(
        F.sum("views").alias("views"), percent_rate().alias("avg_engagement"),
        F.count("video_id").alias("count"))
    label = category_name(F.col("category_id"),
                          F.concat_ws(" ", F.lit("Category"), "category_id"))
    return grouped.withColumn("category", label)


def share_of_total(df: DataFrame, amount: str, share: str = "share_pct") -> DataFrame:
    """Percent of the column's total.

    For rows already aggregated to a few per region, day or group: the window
    has no partitions and must never see the fact table.
    """
    return df.withColumn(share, F.col(amount) * 100.0 / F.sum(amount).over(Window.partitionBy()))


def regional_distribution(df: DataFrame) -> DataFrame:
    return share_of_total(df.groupBy("region_code").agg(F.sum("views").alias("views")), "views")


def hourly_engagement(df: DataFrame) -> DataFrame:
    by_hour = df.groupBy("publish_hour").agg(percent_rate().alias("engagement"))
    return dense_hour_join(by_hour, "publish_hour", "engagement")


def top_channels(df: DataFrame, limit: int = 10) -> DataFrame:
    """Largest channels by views; ties by name.  Planned as take-ordered, not a sort."""
    return (
        df.groupBy(F.col("channel_title").alias("channel"))
        .agg(F.sum("views").alias("total_views"),
             F.round(percent_rate(), 2).alias("avg_engagement"),
             F.count("video_id").alias("count"))
        .orderBy(F.desc("total_views"), "channel").limit(limit)
    )


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "video_id") -> DataFrame:
    """``n`` rows in the order of a hash of the key: random looking, same every run."""
    draw = F.md5(F.concat_ws("#", F.col(key), F.lit(str(seed))))
    return df.orderBy(draw, key).limit(n)


def scatter_sample(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    return sample_rows(df, n, seed).select(
        "video_id", F.col("views").alias("x"), (F.col("engagement_rate") * 100).alias("y"),
        "title", F.col("category_id").alias("category"))


def data_summary(df: DataFrame) -> DataFrame:
    """Totals in one row, with the region list and the rows per category as a map."""
    category_rows = df.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count("*").alias("n"))
    categories = category_rows.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "n"))))).scalar()
    return df.agg(
        F.count("*").alias("total_videos"),
        F.count_distinct("channel_title").alias("unique_channels"),
        F.array_sort(F.collect_set("region_code")).alias("regions"),
        F.min("publish_date").alias("start_date"),
        F.max("publish_date").alias("end_date"),
        F.sum("views").alias("total_views"), F.avg("views").alias("avg_views"),
        F.max("views").alias("max_views"),
        F.sum("likes").alias("total_likes"), F.avg("likes").alias("avg_likes"),
        F.sum("comments").alias("total_comments"), F.avg("comments").alias("avg_comments"),
        F.avg("engagement_rate").alias("avg_engagement_rate"),
    ).withColumn("categories", categories)


def publishing_heatmap(df: DataFrame) -> DataFrame:
    """Mean engagement per hour and weekday (1 = Sunday)."""
    return df.groupBy("publish_hour", F.dayofweek("publish_date").alias("day_of_week")).agg(
        F.avg("engagement_rate").alias("avg_engagement_rate"), F.count("*").alias("videos"))


def engagement_quadrants(df: DataFrame, views_at: int = 100_000, rate_at: float = 0.05) -> DataFrame:
    side = F.when(F.col("views") >= views_at, "High Views").otherwise("Low Views")
    level = F.when(F.col("engagement_rate") >= rate_at, "High Engagement").otherwise("Low Engagement")
    known = df.where("views IS NOT NULL AND engagement_rate IS NOT NULL")
    return known.groupBy(F.concat_ws(" / ", side, level).alias("quadrant")).agg(
        F.count("*").alias("videos"), F.sum("likes").alias("likes"))


def engagement_level_distribution(df: DataFrame) -> DataFrame:
    counts = df.where("engagement_category IS NOT NULL").groupBy(
        F.col("engagement_category").alias("engagement_level")).agg(F.count("*").alias("videos"))
    return share_of_total(counts, "videos")


TAG_BUCKETS = ([1, 3, 5, 10], ["0", "1-2", "3-4", "5-9", "10+"])


def engagement_box_by_tags(df: DataFrame) -> DataFrame:
    """Box-plot figures of the engagement rate per tag-count bucket."""
    rows = df.where("engagement_rate IS NOT NULL").select(
        bands.band(F.col("tag_count"), *TAG_BUCKETS).alias("bucket"), "engagement_rate")
    box = exact_quantiles(rows, ["bucket"], "engagement_rate",
                          {"q1": 0.25, "median": 0.5, "q3": 0.75}, few=True)  # five buckets
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("engagement_rate").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(F.broadcast(box), "bucket")
        .groupBy("bucket", "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("engagement_rate"))).alias("whisker_low"),
             F.max(F.when(inside, F.col("engagement_rate"))).alias("whisker_high"),
             F.count_if(~inside).alias("outliers"), F.count("*").alias("videos"))
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included.

    Also repeats mean and standard deviation, from which a normal curve is drawn.
    """
    known = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    stats = known.agg(F.struct(
        F.min("x").alias("low"), F.max("x").alias("high"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev")).alias("s"))
    span = stats.scalar()
    low = span.getField("low")
    width = (span.getField("high") - low) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))).otherwise(0)
    counts = known.groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return slots.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
        span.getField("mean").alias("mean"), span.getField("stddev").alias("stddev"))


def error_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(prediction_quality(df), "views_prediction_error", bins)


def nlp_scorecard(df: DataFrame, by: str | None = None) -> DataFrame:
    """Scored rows, correct rows, accuracy and mean confidence; overall or by a column."""
    scored = df.where("nlp_predicted_category IS NOT NULL AND nlp_predicted_category <> -1")
    correct = F.count_if(F.col("nlp_predicted_category") == F.col("category_id"))
    return scored.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total_predictions"),
        correct.alias("correct_predictions"),
        F.try_divide(correct, F.count("*")).alias("accuracy"),
        F.avg("nlp_category_confidence").alias("avg_confidence"))


def trending_speed_funnel(df: DataFrame) -> DataFrame:
    label = bands.trending_speed(F.col("time_to_trending_hours"))
    counts = df.groupBy(label.alias("trending_speed")).agg(F.count("*").alias("videos"))
    order = F.array_position(F.array(*[F.lit(x) for x in bands.K.SPEED_BANDS[1]]), F.col("trending_speed"))
    return counts.where("trending_speed IS NOT NULL").withColumn("stage", order.cast("int"))


def trending_calendar(df: DataFrame) -> DataFrame:
    return (
        df.where("trending_date IS NOT NULL")
        .groupBy(F.to_date("trending_date").alias("date")).agg(F.count("*").alias("videos"))
        .withColumn("is_weekend", F.dayofweek("date").isin(1, 7))
    )


def trend_line(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r2 and the points used."""
    points = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL")
    return points.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.count("*").alias("points"))


def daily_views_line(df: DataFrame) -> DataFrame:
    """The line through daily views; x counts days since 1970-01-01."""
    return trend_line(daily_views(df), F.unix_date("date"), F.col("views"))


def views_forecast(df: DataFrame, days: int = 30) -> DataFrame:
    """Daily views for the next days, read off the daily trend line."""
    daily = daily_views(df).where("date IS NOT NULL")
    line = daily.agg(
        F.max("date").alias("last"),
        F.regr_slope(F.col("views").cast("double"), F.unix_date("date").cast("double")).alias("slope"),
        F.regr_intercept(F.col("views").cast("double"), F.unix_date("date").cast("double")).alias("intercept"))
    ahead = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days))))
    date = F.date_add("last", F.col("step"))
    return ahead.select(
        date.alias("date"),
        (F.col("intercept") + F.col("slope") * F.unix_date(date)).alias("forecast_views"))


def lod_fixed_metrics(df: DataFrame) -> DataFrame:
    """Each row with its day's views, its channel's mean engagement and its category's median views.

    The fixed figures are aggregated apart and joined back: a window would pull a
    hot channel or category into one task, a skewed join is split by AQE.
    """
    rows = df.withColumn("publish_day", F.to_date("publish_date"))
    per_day = rows.groupBy("publish_day").agg(F.sum("views").alias("daily_views"))
    per_channel = rows.groupBy("channel_title").agg(F.avg("engagement_rate").alias("channel_avg_engagement"))
    per_category = exact_quantiles(rows, ["category_id"], "views", {"category_median_views": 0.5})
    # Null days, channels and categories are groups too.
    for figures, key in ((per_day, "publish_day"), (per_channel, "channel_title"), (per_category, "category_id")):
        rows = null_safe_join(rows, figures, [key], "left")
    return rows


def actual_vs_predicted(df: DataFrame) -> DataFrame:
    return prediction_quality(df.where("ml_predicted_views IS NOT NULL")).select(
        "video_id", F.col("views").alias("actual_views"),
        F.col("ml_predicted_views").alias("predicted_views"),
        (F.col("views") - F.col("ml_predicted_views")).alias("residual"),
        "views_prediction_error", "views_prediction_quality")


def best_publishing_hours(df: DataFrame, limit: int = 3) -> DataFrame:
    by_hour = df.where("engagement_rate IS NOT NULL").groupBy("publish_hour").agg(
        F.avg("engagement_rate").alias("avg_engagement_rate"), F.count("*").alias("videos"))
    return by_hour.orderBy(F.desc("avg_engagement_rate"), "publish_hour").limit(limit)


def views_and_engagement_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    parts = [histogram(df, c, bins).withColumn("metric", F.lit(c)) for c in ("views", "engagement_rate")]
    return parts[0].unionByName(parts[1])


def seasonal_trend(df: DataFrame) -> DataFrame:
    """Views and engagement per month and per quarter."""
    def per(unit):
        start = F.date_trunc(unit, "publish_date").cast("date")
        return df.groupBy(start.alias("period_start")).agg(
            F.count("*").alias("videos"), F.sum("views").alias("total_views"),
            F.avg("engagement_rate").alias("avg_engagement_rate")
        ).withColumn("period", F.lit(unit))

    return per("month").unionByName(per("quarter"))


def kpi_monitor(df: DataFrame) -> DataFrame:
    """Counts and shares behind the performance indicators."""
    views, predicted = F.col("views"), F.col("nlp_predicted_category")
    error = F.try_divide(F.abs(views - F.col("ml_predicted_views")), views)
    viral = F.count_if(views > 1_000_000)
    engaged = F.count_if(F.col("engagement_rate") > 0.05)
    fast = F.count_if(F.col("time_to_trending_hours") < 24)
    near = F.count_if(error < 0.2)
    accuracy = F.try_divide(F.count_if(predicted == F.col("category_id")), F.count(predicted))
    n = F.count("*")
    return df.agg(
        n.alias("videos"),
        viral.alias("viral_videos"), F.try_divide(viral, n).alias("viral_share"),
        engaged.alias("high_engagement_videos"), F.try_divide(engaged, n).alias("high_engagement_share"),
        fast.alias("fast_trending_videos"),
        F.try_divide(fast, F.count("time_to_trending_hours")).alias("fast_trending_share"),
        accuracy.alias("nlp_accuracy"), (accuracy > 0.85).alias("nlp_accuracy_ok"),
        near.alias("close_predictions"),
        F.try_divide(near, F.count("ml_predicted_views")).alias("close_prediction_share"))
