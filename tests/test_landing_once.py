"""A table that lands in several formats is put together once."""

from pyspark.sql import functions as F

from trendmill.plans import catalogue, landing


def test_all_formats_are_landed_from_one_copy(spark, data, monkeypatch):
    rows = landing.region_rows
    monkeypatch.setattr(landing, "region_rows", lambda *a: rows(*a).withColumn("title", F.current_timestamp().cast("string")))
    loaded = catalogue.QUERIES["load_any_format"](spark, data)
    n = loaded.where("fmt = 'csv'").count()
    assert n > 0 and loaded.select("video_id", "title").distinct().count() == n
