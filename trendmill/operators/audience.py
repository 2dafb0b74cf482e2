"""Audience age groups: indicators, rule labels and preference figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.functions import bands, engagement, text
from trendmill.operators.enrich import group_flags
from trendmill.operators.metrics import share_of_total


def extract_age_indicators(df: DataFrame) -> DataFrame:
    """0/1 and numeric hints at who a video is for.

    Expects title, description, tags, category_id, publish_hour,
    publish_day_of_week (0 = Monday), engagement_rate and duration seconds.
    """
    title, description, tags = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "tags"))
    hour, rate = F.col("publish_hour"), F.coalesce("engagement_rate", F.lit(0.0))
    seconds = F.coalesce(F.col("duration"), F.lit(0))
    out = {
        "title_has_numbers": text.has_pattern(title, r"(?U)\d"),
        "title_word_count": text.word_count(title),
        "title_avg_word_length": text.chars_per_word(title),
        "description_length": F.length(description),
        "description_word_count": text.word_count(description),
        "description_complexity": text.chars_per_word(description),
        "tag_count": text.tag_count(tags, "[|]"),
        "publish_is_morning": hour.between(6, 11),
        "publish_is_afternoon": hour.between(12, 17),
        "publish_is_evening": hour.between(18, 22),
        "publish_is_night": (hour >= 23) | (hour <= 5),
        "publish_is_weekend": F.col("publish_day_of_week") >= 5,
        "high_engagement": rate > 0.05,
        "medium_engagement": rate.between(0.02, 0.05),
        "low_engagement": rate < 0.02,
        "short_duration": seconds < 300,
        "medium_duration": seconds.between(300, 1200),
        "long_duration": seconds > 1200,
    }
    for kind, terms in K.AGE_TITLE_TERMS.items():
        out[f"title_has_{kind}_terms"] = text.has_any_word(title, terms)
    for kind, terms in K.AGE_TAG_TERMS.items():
        out[f"tags_has_{kind}"] = text.has_any_word(tags, terms)
    out |= group_flags(F.col("category_id"),
                       {f"category_is_{name}": ids for name, ids in K.AGE_CATEGORY_GROUPS.items()})
    numeric = {"title_avg_word_length", "description_complexity"}
    return df.withColumns({c: F.coalesce(v if c in numeric else v.cast("int"), F.lit(0))
                           for c, v in out.items()})


def age_labels(df: DataFrame) -> DataFrame:
    """The group with the highest weighted score; ties go to the youngest group."""
    scores = []
    for group, weights in K.AGE_WEIGHTS.items():
        score = F.lit(0)
        for indicator, weight in weights.items():
            score = score + F.col(indicator) * weight
        # Ordered by score, then by the smaller id.
        scores.append(F.struct(score.alias("score"), F.lit(-group).alias("rank")))
    best = F.greatest(*scores)
    labelled = df.withColumn("age_group_id", (-best.getField("rank")).cast("int"))
    return labelled.withColumn("age_group", age_group_name(F.col("age_group_id")))


def age_group_name(group_id):
    names = [part for gid, row in K.AGE_GROUPS.items() for part in (F.lit(gid), F.lit(row[0]))]
    return F.try_element_at(F.create_map(*names), group_id.cast("int"))


def age_bounds_lookup(df: DataFrame, column: str = "age_group") -> DataFrame:
    """Youngest and oldest age and content complexity of each row's group."""
    rows = [F.struct(F.lit(name).alias(column), F.lit(lo).alias("target_age_min"),
                     F.lit(hi).alias("target_age_max"), F.lit(level).alias("content_complexity"))
            for name, lo, hi, level in K.AGE_GROUPS.values()]
    bounds = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    low, high, level = K.AGE_GROUP_FALLBACK
    return df.join(F.broadcast(bounds), column, "left").withColumns({  # seven rows
        "target_age_min": F.coalesce("target_age_min", F.lit(low)),
        "target_age_max": F.coalesce("target_age_max", F.lit(high)),
        "content_complexity": F.coalesce("content_complexity", F.lit(level))})


def age_distribution(df: DataFrame) -> DataFrame:
    return share_of_total(df.groupBy("age_group").agg(F.count("*").alias("videos")), "videos", "percentage")


def age_metric_means(df: DataFrame) -> DataFrame:
    means = {"engagement_rate": "avg_engagement_rate", "views": "avg_views",
             "publish_hour": "avg_publish_hour", "title_length": "avg_title_length",
             "tag_count": "avg_tag_count", "duration": "avg_duration",
             "publish_is_weekend": "weekend_share"}
    return df.groupBy("age_group").agg(*[F.avg(c).alias(n) for c, n in means.items()])


def age_category_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("age_group", "category_id").agg(F.count("*").alias("n"))


def age_category_counts(df: DataFrame) -> DataFrame:
    """Per group a map category -> rows (groups times categories is small)."""
    entries = F.array_sort(F.collect_list(F.struct("category_id", "n")))
    return age_category_rows(df).where("category_id IS NOT NULL").groupBy("age_group").agg(
        F.map_from_entries(entries).alias("category_counts"))


def top_category_per_group(df: DataFrame) -> DataFrame:
    """The most frequent category of each group; ties go to the lower id."""
    ranked = Window.partitionBy("age_group").orderBy(F.desc("n"), "category_id")
    return (
        age_category_rows(df).where("category_id IS NOT NULL")
        .withColumn("place", F.row_number().over(ranked)).where("place = 1")
        .select("age_group", F.col("category_id").alias("top_category"), F.col("n").alias("top_count"))
    )


def age_complexity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("age_group").pivot("content_complexity", ["Simple", "Moderate", "Advanced"]).agg(
        F.count(F.lit(1))).na.fill(0)


def age_hour_heatmap(df: DataFrame) -> DataFrame:
    """Rows per group and hour, one column per hour of the day."""
    cells = [F.count_if(F.col("publish_hour") == h).alias(f"h{h:02d}") for h in range(24)]
    return df.groupBy("age_group").agg(*cells)


def age_insights(df: DataFrame) -> DataFrame:
    """Which group leads by engagement, views and title length, and when each group publishes.

    One row per insight: ``(insight, age_group, label, value)``.
    """
    # Not a filter: on the grouping column it would be pushed below the labels
    # and work them out a second time for every video.
    means = age_metric_means(df)
    named = F.col("age_group").isNotNull()

    def leader(column):
        # Lowest name wins a tie, hence the minimum of (-value, name); nulls never lead.
        entry = F.struct((-F.col(column)).alias("v"), F.col("age_group").alias("g"))
        return F.min(F.when(named & F.col(column).isNotNull(), entry))

    def row(insight, group, label, value):
        return F.struct(F.lit(insight).alias("insight"), group.alias("age_group"),
                        label.cast("string").alias("label"), value.cast("double").alias("value"))

    # The group means are at most one row per age group; one aggregate reads them all.
    hour = F.floor("avg_publish_hour").cast("int")
    peak = row("peak_time", F.col("age_group"), bands.time_of_day(hour, evening_end=22), hour)
    leaders = {"most_engaged": "avg_engagement_rate", "most_viewed": "avg_views",
               "longest_titles": "avg_title_length"}
    whole = means.agg(*[leader(c).alias(name) for name, c in leaders.items()],
                      F.collect_list(F.when(named & F.col("avg_publish_hour").isNotNull(), peak)).alias("peaks"))
    best = F.array(*[F.when(F.col(name).isNotNull(),
                            row(name, F.col(f"{name}.g"), F.lit(None), -F.col(f"{name}.v")))
                     for name in leaders])
    return whole.select(F.inline(F.concat(F.array_compact(best), "peaks")))


def audience_table(videos: DataFrame) -> DataFrame:
    """Videos with indicators, rule label and complexity, ready for the figures above."""
    seconds = text.duration_seconds(F.col("duration"))
    rate = engagement.engagement_rate(F.col("likes"), F.col("comments"), F.col("views"))
    base = videos.withColumns({
        "duration": seconds,
        "engagement_rate": rate,
        "publish_hour": F.hour("publish_date"),
        "publish_day_of_week": F.weekday("publish_date"),
        "title_length": F.length("title"),
    })
    return base.transform(extract_age_indicators).transform(age_labels)
