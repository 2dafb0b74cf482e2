"""Derived columns, in the groups the feature builder adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.functions import bands, engagement, temporal, text


def category_name(column, default="Unknown"):
    """Title of a category id from the fixed table; ``default`` may be a Column or None.

    The table has fifteen rows, so it travels inside the expression rather than
    as a join.
    """
    pairs = [part for cid, title in K.CATEGORY_TITLES.items() for part in (F.lit(cid), F.lit(title))]
    found = F.try_element_at(F.create_map(*pairs), column.cast("int"))
    if default is None:
        return found
    return F.coalesce(found, default if not isinstance(default, str) else F.lit(default))


def temporal_features(df: DataFrame) -> DataFrame:
    publish, trending = F.col("publish_date"), F.col("trending_date")
    hours = temporal.hours_between(publish, trending)
    return df.withColumns({
        **temporal.calendar(publish),
        **temporal.cyclical(publish),
        **temporal.time_flags(publish),
        "time_to_trending_hours": hours,
        "trending_speed": bands.trending_speed(hours),
    })


def text_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "tags")})
    title, description, tags = F.col("title"), F.col("description"), F.col("tags")
    title_length, description_length = F.length(title), F.length(description)
    total = title_length + description_length + F.length(tags)
    return df.withColumns({
        "title_length": title_length,
        "title_word_count": text.word_count(title),
        "title_char_per_word": text.chars_per_word(title),
        **text.title_signals(title),
        "description_length": description_length,
        "description_word_count": text.word_count(description),
        "description_char_per_word": text.chars_per_word(description),
        **text.description_signals(description),
        "tag_count": text.tag_count(tags),
        "avg_tag_length": text.avg_tag_length(tags),
        "unique_tag_count": text.unique_tag_count(tags),
        "total_text_length": total,
        "title_to_desc_ratio": engagement.safe_ratio(title_length, description_length, title_length),
        "desc_to_total_ratio": engagement.safe_ratio(description_length, total),
    })


def engagement_features(df: DataFrame) -> DataFrame:
    """Null counts count as zero here, as the feature builder has it."""
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("views", "likes", "comments")})
    views, likes, comments = F.col("views"), F.col("likes"), F.col("comments")
    rate = engagement.engagement_rate(likes, comments, views)
    return df.withColumns({
        "engagement_rate": rate,
        "like_rate": engagement.safe_ratio(likes, views),
        "comment_rate": engagement.safe_ratio(comments, views),
        "like_to_comment_ratio": engagement.like_to_comment_ratio(likes, comments),
        "log_views": F.log1p(views),
        "log_likes": F.log1p(likes),
        "log_comments": F.log1p(comments),
        "engagement_score": engagement.engagement_score(likes, comments, rate),
        "view_category": bands.view_category(views),
        "engagement_category": bands.engagement_category(rate),
    })


def group_flags(column, groups: dict) -> dict:
    """0/1 membership of a value in each named list; null belongs to none."""
    return {name: F.coalesce(column.isin(*members), F.lit(False)).cast("int")
            for name, members in groups.items()}


def category_groups(category) -> dict:
    return group_flags(category, {
        "is_entertainment": K.ENTERTAINMENT_CATEGORIES,
        "is_educational": K.EDUCATIONAL_CATEGORIES,
        "is_lifestyle": K.LIFESTYLE_CATEGORIES,
    })


def region_groups(region) -> dict:
    return group_flags(region, {
        "is_english_speaking": K.ENGLISH_REGIONS,
        "is_european": K.EUROPEAN_REGIONS,
        "is_asian": K.ASIAN_REGIONS,
    })


def presence_flags(description, tags) -> dict:
    return {
        "has_description": F.coalesce(~description.isin("", K.NO_DESCRIPTION), F.lit(False)),
        "has_tags": text.tag_count(tags) > 0,
    }


def channel_features(channel) -> dict:
    return {
        "channel_name_length": F.length(channel),
        "channel_word_count": text.word_count(channel),
        "channel_has_numbers": text.has_pattern(channel, r"(?U)\d"),
    }


def categorical_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "category_name": category_name(F.col("category_id")),
        **category_groups(F.col("category_id")),
        **region_groups(F.col("region_code")),
        **{k: v.cast("int") for k, v in
           presence_flags(F.col("description"), F.col("tags")).items()},
        **channel_features(F.col("channel_title")),
    })


def interaction_features(df: DataFrame) -> DataFrame:
    category = F.col("category_id")
    return df.withColumns({
        "title_length_by_category": F.col("title_length") * category,
        "tag_count_by_category": F.col("tag_count") * category,
        "hour_by_category": F.col("publish_hour") * category,
        "engagement_by_title_length": F.col("engagement_rate") * F.col("title_length"),
        "engagement_by_tag_count": F.col("engagement_rate") * F.col("tag_count"),
        "region_category_combo": F.concat(F.col("region_code"), F.lit("_"), category.cast("string")),
    })


def build_features(df: DataFrame) -> DataFrame:
    """All feature groups in order: time, text, engagement, categorical, interactions."""
    for step in (temporal_features, text_features, engagement_features,
                 categorical_features, interaction_features):
        df = df.transform(step)
    return df


def analytics_columns(df: DataFrame) -> DataFrame:
    """The analytics table behind the views: one narrow projection, no shuffle.

    Counts keep their nulls (a null like count gives a null rate), since the
    views average over known values only.
    """
    views, likes, comments = F.col("views"), F.col("likes"), F.col("comments")
    title, description, tags = F.col("title"), F.col("description"), F.col("tags")
    publish, trending = F.col("publish_date"), F.col("trending_date")
    rate = engagement.engagement_rate(likes, comments, views)
    return df.withColumns({
        "engagement_rate": rate,
        "view_category": bands.view_category(views),
        "engagement_category": bands.engagement_category(rate),
        "like_rate": engagement.safe_ratio(likes, views),
        "comment_rate": engagement.safe_ratio(comments, views),
        "like_to_comment_ratio": engagement.like_to_comment_ratio(likes, comments),
        "title_length": F.length(title),
        "description_length": F.length(description),
        "tag_count": text.tag_count(tags),
        "title_word_count": text.word_count(title),
        **presence_flags(description, tags),
        "time_to_trending_hours": temporal.hours_between(publish, trending),
        **temporal.calendar(publish),
        **temporal.time_flags(publish),
    })
