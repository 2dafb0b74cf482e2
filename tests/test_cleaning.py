"""Cleaning, against the kinds of dirt it is meant for."""

from pyspark.sql import functions as F

from trendmill.operators import clean

DIRTY = [
    ("test1", "First", "ok", "a|b", "20", "Chan", "1000", "10", 5, "2023-01-01", "2023-01-02", 1),
    ("test2", "  Two   words ", None, None, "45", "Chan", "-100", "-50", 5, "invalid_date", None, 2),
    ("test3", None, "", "x,y|z#", "?", "Chan", "n/a", "7", None, None, "2023-01-05", 3),
    ("test1", "Later", "ok", "a", "10", "Chan", "2000", "20", 5, "2023-01-03", "2023-01-04", 4),
]
SCHEMA = ("video_id string, title string, description string, tags string, category_id string, "
          "channel_title string, views string, likes string, comments int, publish_date string, "
          "trending_date string, seq int")


def dirty(spark):
    return spark.createDataFrame(DIRTY, SCHEMA)


def test_last_row_of_a_key_survives(spark):
    kept = clean.dedup_keep_last(dirty(spark), ["video_id"], ["seq"])
    assert kept.columns == dirty(spark).columns
    assert {(r.video_id, r.title) for r in kept.collect()} == {
        ("test1", "Later"), ("test2", "  Two   words "), ("test3", None)}


def test_dedup_of_a_hot_key_matches_brute_force(spark):
    # A third of all rows share one key.
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        (F.col("id") * 7919 % 30_011).alias("ts"), F.col("id").alias("payload"))
    got = {(r.k, r.ts, r.payload) for r in clean.dedup_keep_last(df, ["k"], ["ts"]).collect()}
    best = {}
    for r in df.collect():
        if r.k not in best or (r.ts, r.payload) > best[r.k]:
            best[r.k] = (r.ts, r.payload)
    assert got == {(k, *v) for k, v in best.items()}


def test_whole_sequence(spark):
    out = {r.video_id: r for r in clean.comprehensive_clean(dirty(spark), ["seq"], F.lit("2024-01-01")).collect()}
    assert set(out) == {"test1", "test2", "test3"}
    two = out["test2"]
    assert (two.title, two.description, two.tags, two.views, two.likes, two.category_id) == (
        "Two words", "No description available", "", 0, 0, 44)
    assert str(two.publish_date) == "2000-01-01 00:00:00" and str(two.trending_date) == "2024-01-01 00:00:00"
    assert out["test3"].tags == "x,y|z" and out["test3"].category_id == 1 and out["test3"].title == ""
    assert out["test1"].views == 2000 and out["test1"].time_to_trending_hours == 24.0


def test_report_counts(spark):
    r = clean.cleaning_report(dirty(spark), ["seq"]).first()
    # Corrected: two negative counts, one category beyond the range and one unreadable.
    assert (r.initial_records, r.final_records, r.duplicates_removed, r.nulls_removed,
            r.invalid_values_corrected) == (4, 3, 1, 0, 4)


def test_category_modes(spark):
    df = spark.createDataFrame([(0,), (1,), (44,), (50,), (None,)], "category_id int")
    assert [r[0] for r in clean.fix_category_id(df, "reset").collect()] == [1, 1, 44, 1, None]
    assert [r[0] for r in clean.fix_category_id(df, "clip").collect()] == [1, 1, 44, 44, None]
