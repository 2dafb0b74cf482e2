"""F*: derived columns, each checked on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import doc_videos, table, videos
from trendmill.functions import bands, engagement, temporal, text
from trendmill.operators import audience, enrich, views
from trendmill.plans.registry import query
from trendmill.plans.sqltext import (
    RATE, band, enriched_sql, hours, in_list, part_of_day, q, ratio, tag_count, videos_sql,
    with_tables, words,
)
from trendmill.plans.tables import enriched, scored


@query("engagement_rate", videos_sql(f"""
SELECT video_id, {RATE} AS engagement_rate,
  CAST(likes + comments AS DOUBLE) / CASE WHEN views = 0 THEN 1 ELSE views END AS engagement_rate_floor_one
FROM videos"""), doubles="engagement_rate engagement_rate_floor_one")
def engagement_rate(spark, sf):
    counts = F.col("likes"), F.col("comments"), F.col("views")
    return videos(spark, sf).select(
        "video_id", engagement.engagement_rate(*counts).alias("engagement_rate"),
        engagement.engagement_rate(*counts, zero_views_as_one=True).alias("engagement_rate_floor_one"))


@query("time_to_trending_hours", videos_sql(f"""
SELECT video_id, {hours('publish_date', 'trending_date')} AS hours_exact,
  date_diff('day', CAST(publish_date AS DATE), CAST(trending_date AS DATE)) * 24.0 AS hours_by_day
FROM videos"""), doubles="hours_exact hours_by_day")
def time_to_trending_hours(spark, sf):
    publish, trending = F.col("publish_date"), F.col("trending_date")
    return videos(spark, sf).select(
        "video_id", temporal.hours_between(publish, trending).alias("hours_exact"),
        temporal.hours_between(publish, trending, "days").alias("hours_by_day"))


@query("publish_calendar", enriched_sql("""
SELECT video_id, publish_hour, publish_day_of_week, publish_day_of_month, publish_week, publish_month,
  publish_quarter, publish_year FROM enriched"""))
def publish_calendar(spark, sf):
    return videos(spark, sf).select(
        "video_id", *[c.alias(n) for n, c in temporal.calendar(F.col("publish_date")).items()])


def _angles():
    out = []
    for name, value, period in (("hour", "hour(publish_date)", 24),
                                ("day", "(isodow(publish_date) - 1)", 7),
                                ("month", "month(publish_date)", 12)):
        out.append(f"sin(2 * pi() * {value} / {period}) AS publish_{name}_sin")
        out.append(f"cos(2 * pi() * {value} / {period}) AS publish_{name}_cos")
    return ", ".join(out)


@query("cyclical_encoding", videos_sql(f"SELECT video_id, {_angles()} FROM videos"),
       doubles=" ".join(f"publish_{n}_{f}" for n in ("hour", "day", "month") for f in ("sin", "cos")))
def cyclical_encoding(spark, sf):
    return videos(spark, sf).select(
        "video_id", *[c.alias(n) for n, c in temporal.cyclical(F.col("publish_date")).items()])


@query("time_flags", enriched_sql(
    "SELECT video_id, is_weekend, is_business_hours, is_prime_time FROM enriched"))
def time_flags(spark, sf):
    return videos(spark, sf).select(
        "video_id", *[c.alias(n) for n, c in temporal.time_flags(F.col("publish_date")).items()])


@query("publish_time_of_day", videos_sql(f"""
SELECT video_id, {part_of_day('hour(publish_date)')} AS part_of_day,
  {part_of_day('hour(publish_date)', 22)} AS part_of_day_audience FROM videos"""))
def publish_time_of_day(spark, sf):
    hour = F.hour("publish_date")
    return videos(spark, sf).select("video_id", bands.time_of_day(hour).alias("part_of_day"),
                                    bands.time_of_day(hour, 22).alias("part_of_day_audience"))


_PER_WORD = "CASE WHEN len({w}) > 0 THEN length({c}) / len({w}) ELSE 0 END"


@query("text_lengths", with_tables(f"""
SELECT doc_id, CAST(length(title) AS INTEGER) AS title_length,
  CAST(len({words('title')}) AS INTEGER) AS title_word_count,
  {_PER_WORD.format(w=words('title'), c='title')} AS title_char_per_word,
  CAST(length(description) AS INTEGER) AS description_length,
  CAST(len({words('description')}) AS INTEGER) AS description_word_count,
  {_PER_WORD.format(w=words('description'), c='description')} AS description_char_per_word
FROM doc_videos""", "docs"), doubles="title_char_per_word description_char_per_word")
def text_lengths(spark, sf):
    title, description = F.col("title"), F.col("description")
    return doc_videos(spark, sf).select(
        "doc_id", F.length(title).alias("title_length"), text.word_count(title).alias("title_word_count"),
        text.chars_per_word(title).alias("title_char_per_word"),
        F.length(description).alias("description_length"),
        text.word_count(description).alias("description_word_count"),
        text.chars_per_word(description).alias("description_char_per_word"))


_TAGS = (r"list_filter(list_transform(regexp_split_to_array(coalesce(tags, ''), '[|,;]'), "
         r"lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '' AND t <> '[none]')")


@query("tag_metrics", videos_sql(f"""
SELECT video_id, CAST({tag_count('tags')} AS INTEGER) AS tag_count,
  CAST({tag_count('tags', '[|]')} AS INTEGER) AS tag_count_pipe,
  CASE WHEN len({_TAGS}) > 0 THEN list_sum(list_transform({_TAGS}, lambda t: length(t))) / len({_TAGS})
    ELSE 0 END AS avg_tag_length,
  CAST(len(list_distinct(list_transform({_TAGS}, lambda t: lower(t)))) AS INTEGER) AS unique_tag_count
FROM videos"""), doubles="avg_tag_length")
def tag_metrics(spark, sf):
    tags = F.col("tags")
    return videos(spark, sf).select(
        "video_id", text.tag_count(tags).alias("tag_count"), text.tag_count(tags, "[|]").alias("tag_count_pipe"),
        text.avg_tag_length(tags).alias("avg_tag_length"), text.unique_tag_count(tags).alias("unique_tag_count"))


@query("title_signals", with_tables(rf"""
SELECT doc_id, CAST(regexp_matches(title, '[0-9]') AS INTEGER) AS title_has_numbers,
  CAST(regexp_matches(title, '[A-Z]') AS INTEGER) AS title_has_uppercase,
  CAST(length(title) - length(replace(title, '!', '')) AS INTEGER) AS title_exclamation_count,
  CAST(length(title) - length(replace(title, '?', '')) AS INTEGER) AS title_question_count,
  CAST(regexp_matches(title, {q(r'(?i)\b(' + '|'.join(K.CLICKBAIT_TERMS) + r')\b')}) AS INTEGER)
    AS title_has_clickbait_words
FROM doc_videos""", "docs"))
def title_signals(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in text.title_signals(F.col("title")).items()])


_EMOJI = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in K.EMOJI_RANGES) + "]"


@query("description_signals", with_tables(f"""
SELECT doc_id, CAST(contains(description, 'http') AS INTEGER) AS description_has_links,
  CAST(regexp_matches(description, {q(_EMOJI)}) AS INTEGER) AS description_has_emoji
FROM doc_videos""", "docs"))
def description_signals(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in text.description_signals(F.col("description")).items()])


@query("text_ratios", with_tables(f"""
SELECT doc_id, CAST(total AS INTEGER) AS total_text_length,
  {ratio('t', 'd', 't')} AS title_to_desc_ratio, {ratio('d', 'total')} AS desc_to_total_ratio
FROM (SELECT doc_id, length(title) AS t, length(description) AS d,
        length(title) + length(description) + length(tags) AS total FROM doc_videos)""", "docs"),
       doubles="title_to_desc_ratio desc_to_total_ratio")
def text_ratios(spark, sf):
    return enrich.text_features(doc_videos(spark, sf)).select(
        "doc_id", "total_text_length", "title_to_desc_ratio", "desc_to_total_ratio")


@query("presence_flags", enriched_sql("SELECT video_id, has_description, has_tags FROM enriched"))
def presence_flags(spark, sf):
    flags = enrich.presence_flags(F.col("description"), F.col("tags"))
    return videos(spark, sf).select("video_id", *[c.alias(n) for n, c in flags.items()])


@query("view_category", videos_sql(f"""
SELECT video_id, views, {band('views', *K.VIEW_BANDS)} AS view_category,
  {band('views', *K.VIEW_BANDS, closed='<=')} AS view_category_right_closed FROM videos"""))
def view_category(spark, sf):
    return videos(spark, sf).select(
        "video_id", "views", bands.view_category(F.col("views")).alias("view_category"),
        bands.view_category(F.col("views"), right_closed=True).alias("view_category_right_closed"))


@query("engagement_category", enriched_sql(f"""
SELECT video_id, engagement_category,
  {band('engagement_rate', *K.ENGAGEMENT_BANDS, closed='<=')} AS engagement_category_right_closed
FROM enriched"""))
def engagement_category(spark, sf):
    rate = F.col("engagement_rate")
    return enriched(spark, sf).select(
        "video_id", bands.engagement_category(rate).alias("engagement_category"),
        bands.engagement_category(rate, right_closed=True).alias("engagement_category_right_closed"))


@query("trending_speed", enriched_sql(f"""
SELECT video_id, {band('time_to_trending_hours', *K.SPEED_BANDS, closed='<=')} AS trending_speed
FROM enriched"""))
def trending_speed(spark, sf):
    return enriched(spark, sf).select(
        "video_id", bands.trending_speed(F.col("time_to_trending_hours")).alias("trending_speed"))


@query("engagement_ratios", enriched_sql(
    "SELECT video_id, like_rate, comment_rate, like_to_comment_ratio FROM enriched"),
       doubles="like_rate comment_rate like_to_comment_ratio")
def engagement_ratios(spark, sf):
    return enriched(spark, sf).select("video_id", "like_rate", "comment_rate", "like_to_comment_ratio")


@query("log_engagement", videos_sql(f"""
SELECT video_id, ln(1 + views) AS log_views, ln(1 + likes) AS log_likes, ln(1 + comments) AS log_comments,
  0.5 * ln(1 + likes) + 0.3 * ln(1 + comments) + 0.2 * {RATE} AS engagement_score
FROM (SELECT video_id, views, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments FROM videos)"""),
       doubles="log_views log_likes log_comments engagement_score")
def log_engagement(spark, sf):
    return enrich.engagement_features(videos(spark, sf)).select(
        "video_id", "log_views", "log_likes", "log_comments", "engagement_score")


@query("category_groups", videos_sql(f"""
SELECT video_id, CAST(category_id IN {in_list(K.ENTERTAINMENT_CATEGORIES)} AS INTEGER) AS is_entertainment,
  CAST(category_id IN {in_list(K.EDUCATIONAL_CATEGORIES)} AS INTEGER) AS is_educational,
  CAST(category_id IN {in_list(K.LIFESTYLE_CATEGORIES)} AS INTEGER) AS is_lifestyle FROM videos"""))
def category_groups(spark, sf):
    return videos(spark, sf).select(
        "video_id", *[c.alias(n) for n, c in enrich.category_groups(F.col("category_id")).items()])


@query("region_groups", videos_sql(f"""
SELECT video_id, CAST(region_code IN {in_list(K.ENGLISH_REGIONS)} AS INTEGER) AS is_english_speaking,
  CAST(region_code IN {in_list(K.EUROPEAN_REGIONS)} AS INTEGER) AS is_european,
  CAST(region_code IN {in_list(K.ASIAN_REGIONS)} AS INTEGER) AS is_asian FROM videos"""))
def region_groups(spark, sf):
    return videos(spark, sf).select(
        "video_id", *[c.alias(n) for n, c in enrich.region_groups(F.col("region_code")).items()])


@query("channel_features", with_tables(f"""
SELECT doc_id, CAST(length(channel_title) AS INTEGER) AS channel_name_length,
  CAST(len({words('channel_title')}) AS INTEGER) AS channel_word_count,
  CAST(regexp_matches(channel_title, '[0-9]') AS INTEGER) AS channel_has_numbers FROM doc_videos""", "docs"))
def channel_features(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in enrich.channel_features(F.col("channel_title")).items()])


@query("interaction_features", enriched_sql("""
SELECT video_id, title_length * category_id AS title_length_by_category,
  tag_count * category_id AS tag_count_by_category, publish_hour * category_id AS hour_by_category,
  engagement_rate * title_length AS engagement_by_title_length,
  engagement_rate * tag_count AS engagement_by_tag_count,
  region_code || '_' || category_id AS region_category_combo FROM enriched"""),
       doubles="engagement_by_title_length engagement_by_tag_count")
def interaction_features(spark, sf):
    return enrich.interaction_features(enriched(spark, sf)).select(
        "video_id", "title_length_by_category", "tag_count_by_category", "hour_by_category",
        "engagement_by_title_length", "engagement_by_tag_count", "region_category_combo")


@query("duration_seconds", """
SELECT event_id, duration, CAST(CASE WHEN starts_with(duration, 'PT') THEN
    coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)H', 1) AS INTEGER), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)M', 1) AS INTEGER), 0) * 60
    + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)S', 1) AS INTEGER), 0)
  ELSE 0 END AS INTEGER) AS seconds
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PT' || CAST(floor(value) AS BIGINT) || 'M' || event_id % 60 || 'S'
    WHEN 1 THEN 'PT' || event_id % 5 || 'H' WHEN 2 THEN 'P' || event_id % 9 || 'D'
    ELSE 'PT' || event_id % 3 || 'H' || event_id % 60 || 'M' || CAST(floor(value) AS BIGINT) || 'S' END AS duration
  FROM events)""")
def duration_seconds(spark, sf):
    n, whole = F.col("event_id"), F.floor("value")
    duration = (
        F.when(n % 4 == 0, F.concat(F.lit("PT"), whole, F.lit("M"), n % 60, F.lit("S")))
        .when(n % 4 == 1, F.concat(F.lit("PT"), n % 5, F.lit("H")))
        .when(n % 4 == 2, F.concat(F.lit("P"), n % 9, F.lit("D")))
        .otherwise(F.concat(F.lit("PT"), n % 3, F.lit("H"), n % 60, F.lit("M"), whole, F.lit("S"))))
    return table(spark, sf, "events").select("event_id", duration.alias("duration")).withColumn(
        "seconds", text.duration_seconds(F.col("duration")))


@query("prediction_quality", enriched_sql(f"""
SELECT video_id, abs(views - ml_predicted_views) AS views_prediction_error,
  abs(engagement_rate - ml_predicted_engagement_rate) AS engagement_prediction_error,
  {band('abs(views - ml_predicted_views) / views', *K.ERROR_BANDS, closed='<=')} AS views_prediction_quality
FROM enriched"""), doubles="views_prediction_error engagement_prediction_error")
def prediction_quality(spark, sf):
    return views.prediction_quality(scored(spark, sf)).select(
        "video_id", "views_prediction_error", "engagement_prediction_error", "views_prediction_quality")


@query("content_complexity", with_tables(f"""
SELECT doc_id, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END
    AS avg_word_length,
  CAST(len(list_distinct(w)) AS INTEGER) AS unique_words, CAST(len(w) AS INTEGER) AS total_words
FROM (SELECT doc_id, {words('description')} AS w FROM doc_videos)""", "docs"), doubles="avg_word_length")
def content_complexity(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in text.content_complexity(F.col("description")).items()])


def _hits(terms):
    return "(" + " + ".join(f"CAST(contains(d, {q(t)}) AS INTEGER)" for t in terms) + ")"


@query("sentiment_indicators", with_tables(f"""
SELECT doc_id, {_hits(K.POSITIVE_TERMS)} AS positive, {_hits(K.NEGATIVE_TERMS)} AS negative,
  CAST(n - {_hits(K.POSITIVE_TERMS)} - {_hits(K.NEGATIVE_TERMS)} AS INTEGER) AS neutral
FROM (SELECT doc_id, lower(description) AS d, len({words('description')}) AS n FROM doc_videos)""", "docs"))
def sentiment_indicators(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in text.sentiment_indicators(F.col("description")).items()])


_THEMES = ", ".join(f"CASE WHEN {_hits(terms)} > 0 THEN {q(theme)} END"
                    for theme, terms in K.THEME_KEYWORDS.items())


@query("content_themes", with_tables(f"""
SELECT doc_id, concat_ws(',', {_THEMES}) AS themes
FROM (SELECT doc_id, lower(description) AS d FROM doc_videos)""", "docs"))
def content_themes(spark, sf):
    return doc_videos(spark, sf).select(
        "doc_id", F.concat_ws(",", text.content_themes(F.col("description"))).alias("themes"))


def _flag(condition: str, name: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER) AS {name}"


def _word_flag(column: str, terms: str, name: str) -> str:
    pattern = r"(?i)\b(" + terms + r")\b"
    return _flag(f"regexp_matches({column}, {q(pattern)})", name)


def _mean_word(column: str, name: str) -> str:
    n = f"len({words(column)})"
    return f"CASE WHEN {n} > 0 THEN length({column}) / {n} ELSE 0 END AS {name}"


INDICATORS_SQL = ",\n    ".join([
    "CAST(regexp_matches(title, '[0-9]') AS INTEGER) AS title_has_numbers",
    f"CAST(len({words('title')}) AS INTEGER) AS title_word_count",
    _mean_word("title", "title_avg_word_length"),
    *[_word_flag("title", t, f"title_has_{k}_terms") for k, t in K.AGE_TITLE_TERMS.items()],
    "CAST(length(description) AS INTEGER) AS description_length",
    f"CAST(len({words('description')}) AS INTEGER) AS description_word_count",
    _mean_word("description", "description_complexity"),
    f"CAST({tag_count('tags', '[|]')} AS INTEGER) AS tag_count",
    *[_word_flag("tags", t, f"tags_has_{k}") for k, t in K.AGE_TAG_TERMS.items()],
    *[_flag(f"category_id IN {in_list(v)}", f"category_is_{k}") for k, v in K.AGE_CATEGORY_GROUPS.items()],
    _flag("publish_hour BETWEEN 6 AND 11", "publish_is_morning"),
    _flag("publish_hour BETWEEN 12 AND 17", "publish_is_afternoon"),
    _flag("publish_hour BETWEEN 18 AND 22", "publish_is_evening"),
    _flag("publish_hour >= 23 OR publish_hour <= 5", "publish_is_night"),
    _flag("publish_day_of_week >= 5", "publish_is_weekend"),
    _flag("rate > 0.05", "high_engagement"), _flag("rate BETWEEN 0.02 AND 0.05", "medium_engagement"),
    _flag("rate < 0.02", "low_engagement"),
    _flag("duration < 300", "short_duration"), _flag("duration BETWEEN 300 AND 1200", "medium_duration"),
    _flag("duration > 1200", "long_duration"),
])

AUDIENCE_SQL = f"""
facts AS (
  SELECT video_id, views, category_id, coalesce(title, '') AS title, coalesce(description, '') AS description,
    coalesce(tags, '') AS tags, engagement_rate, coalesce(engagement_rate, 0) AS rate,
    publish_hour, publish_day_of_week, title_length,
    CAST(regexp_extract(duration, 'PT([0-9]+)M', 1) AS INTEGER) * 60
      + CAST(regexp_extract(duration, '([0-9]+)S', 1) AS INTEGER) AS duration
  FROM enriched
), indicators AS (
  SELECT video_id, views, category_id, engagement_rate, publish_hour, title_length, duration,
    {INDICATORS_SQL}
  FROM facts
), scored AS (
  SELECT *, [{', '.join('(' + ' + '.join(f'{w} * {i}' for i, w in weights.items()) + ')'
                        for weights in K.AGE_WEIGHTS.values())}] AS scores
  FROM indicators
), audience AS (
  SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS age_group_id,
    [{', '.join(q(row[0]) for row in K.AGE_GROUPS.values())}][list_position(scores, list_max(scores))] AS age_group
  FROM scored
)"""


def audience_sql(body: str) -> str:
    return enriched_sql(body, AUDIENCE_SQL.strip())


@query("age_indicators", audience_sql(
    f"SELECT video_id, {', '.join(K.AGE_FEATURES)} FROM audience"),
       doubles="title_avg_word_length description_complexity")
def age_indicators(spark, sf):
    return audience.audience_table(videos(spark, sf)).select("video_id", *K.AGE_FEATURES)


@query("age_labels", audience_sql("SELECT video_id, age_group_id, age_group FROM audience"))
def age_labels(spark, sf):
    return audience.audience_table(videos(spark, sf)).select("video_id", "age_group_id", "age_group")


def _bounds(position: int) -> str:
    arms = " ".join(f"WHEN {gid} THEN {q(row[position]) if isinstance(row[position], str) else row[position]}"
                    for gid, row in K.AGE_GROUPS.items())
    return f"CASE age_group_id {arms} END"


@query("age_bounds_lookup", audience_sql(f"""
SELECT video_id, age_group, {_bounds(1)} AS target_age_min, {_bounds(2)} AS target_age_max,
  {_bounds(3)} AS content_complexity FROM audience"""))
def age_bounds_lookup(spark, sf):
    return audience.age_bounds_lookup(audience.audience_table(videos(spark, sf))).select(
        "video_id", "age_group", "target_age_min", "target_age_max", "content_complexity")
