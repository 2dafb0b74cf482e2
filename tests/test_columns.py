"""Golden edge rows of the column builders."""

import pytest
from pyspark.sql import functions as F

from trendmill.functions import bands, engagement, temporal, text


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_view_bands_on_their_edges(spark):
    rows = [(v,) for v in (0, 9_999, 10_000, 10_001, 99_999, 100_000, 999_999, 1_000_000, None)]
    left = values(spark, rows, "v long", bands.view_category(F.col("v")))
    assert left == ["Low", "Low", "Medium", "Medium", "Medium", "High", "High", "Viral", None]
    right = values(spark, rows, "v long", bands.view_category(F.col("v"), right_closed=True))
    assert right == ["Low", "Low", "Low", "Medium", "Medium", "Medium", "High", "High", None]


def test_engagement_bands(spark):
    rows = [(0.009,), (0.01,), (0.05,), (None,)]
    assert values(spark, rows, "r double", bands.engagement_category(F.col("r"))) == ["Low", "Medium", "High", None]
    closed = bands.engagement_category(F.col("r"), right_closed=True)
    assert values(spark, rows, "r double", closed) == ["Low", "Low", "Medium", None]


def test_trending_speed_and_day_parts(spark):
    speeds = values(spark, [(24.0,), (72.0,), (168.0,), (168.5,), (None,)], "h double", bands.trending_speed(F.col("h")))
    assert speeds == ["Very Fast", "Fast", "Medium", "Slow", None]
    hours = [(h,) for h in (5, 6, 11, 12, 17, 18, 22, 23)]
    assert values(spark, hours, "h int", bands.time_of_day(F.col("h"))) == [
        "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Evening"]
    assert values(spark, hours, "h int", bands.time_of_day(F.col("h"), 22))[-1] == "Night"


def test_rates(spark):
    rows = [(10, 5, 100), (10, 5, 0), (None, 5, 100)]
    schema = "l long, c long, v long"
    cols = F.col("l"), F.col("c"), F.col("v")
    assert values(spark, rows, schema, engagement.engagement_rate(*cols)) == [0.15, 0.0, None]
    assert values(spark, rows[:2], schema, engagement.engagement_rate(*cols, zero_views_as_one=True)) == [0.15, 15.0]
    assert values(spark, [(10, 0, 1)], schema, engagement.like_to_comment_ratio(F.col("l"), F.col("c"))) == [10.0]


def test_hours_between(spark):
    rows = [("2023-01-01 23:00:00", "2023-01-02 01:00:00"), ("2023-01-02 01:00:00", "2023-01-01 23:00:00"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in "ab"])
    exact = [r[0] for r in df.select(temporal.hours_between(F.col("a"), F.col("b"))).collect()]
    days = [r[0] for r in df.select(temporal.hours_between(F.col("a"), F.col("b"), "days")).collect()]
    assert exact == [2.0, 0.0, None]
    assert days == [24.0, -24.0, None]
    with pytest.raises(ValueError):
        temporal.hours_between(F.col("a"), F.col("b"), "other")


def test_weekend(spark):
    df = spark.sql("SELECT explode(array(DATE'2024-03-01', DATE'2024-03-02', DATE'2024-03-03', DATE'2024-03-04')) d")
    flags = [r[0] for r in df.select(temporal.time_flags(F.col("d").cast("timestamp"))["is_weekend"]).collect()]
    assert flags == [0, 1, 1, 0]


def test_tags(spark):
    rows = [("",), (None,), ("[none]",), ("a|b,c;d",), ("A|a",), (" x | |yy",)]
    assert values(spark, rows, "t string", text.tag_count(F.col("t"))) == [0, 0, 0, 4, 2, 3]
    assert values(spark, rows, "t string", text.unique_tag_count(F.col("t"))) == [0, 0, 0, 4, 1, 2]
    assert values(spark, rows, "t string", text.avg_tag_length(F.col("t"))) == [0, 0, 0, 1, 1, 1.5]


def test_durations(spark):
    rows = [("PT4M13S",), ("PT1H",), ("P1D",), ("",), ("PT1H2M3S",)]
    assert values(spark, rows, "d string", text.duration_seconds(F.col("d"))) == [253, 3600, 0, 0, 3723]


def test_titles(spark):
    rows = [("You won't believe this",), ("été 😀!",), ("   ",), ("Amazingly secret 7?",)]
    signals = text.title_signals(F.col("t"))
    assert values(spark, rows, "t string", signals["title_has_clickbait_words"]) == [1, 0, 0, 1]
    assert values(spark, rows, "t string", signals["title_has_numbers"]) == [0, 0, 0, 1]
    assert values(spark, rows, "t string", text.word_count(F.col("t"))) == [4, 2, 0, 3]
    assert values(spark, rows, "t string", text.description_signals(F.col("t"))["description_has_emoji"]) == [0, 1, 0, 0]
    assert values(spark, [(" Été  ça! #x ",)], "t string", text.clean_title(F.col("t"))) == ["Été ça! x"]


def test_model_tokens(spark):
    rows = [("The Cats @bob #tag visit https://x.y/z www.q.com 42 dogs é",), (None,)]
    assert values(spark, rows, "t string", text.model_tokens(F.col("t"))) == [["cats", "visit", "dogs"], []]


def test_sentiment_and_themes(spark):
    rows = [("Great fun, sadly a bad game",), (None,)]
    s = text.sentiment_indicators(F.col("t"))
    got = spark.createDataFrame(rows, "t string").select(*[c.alias(n) for n, c in s.items()]).collect()
    assert tuple(got[0]) == (2, 2, 2) and tuple(got[1]) == (0, 0, 0)
    assert values(spark, rows, "t string", text.content_themes(F.col("t"))) == [["Entertainment"], []]
