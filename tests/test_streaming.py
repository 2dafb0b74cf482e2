"""Streams give the batch result, also when files keep arriving."""

from pyspark.sql import functions as F

from trendmill.streaming import jobs


def test_files_that_arrive_later_are_added_once(spark, tmp_path):
    land, state = str(tmp_path / "in"), str(tmp_path / "state")
    first = spark.createDataFrame([("c1", 5, "v1"), ("c2", 7, "v2")], "channel_title string, views long, video_id string")
    first = first.withColumn("publish_date", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    first.write.parquet(land)

    def refresh():
        out = jobs.stream_dashboard_refresh(spark, land, str(tmp_path / "out"), first.schema, state)
        return {r.channel_title: (r.videos, r.total_views) for r in out.collect()}

    assert refresh() == {"c1": (1, 5), "c2": (1, 7)}
    assert refresh() == {"c1": (1, 5), "c2": (1, 7)}
    first.where("channel_title = 'c1'").write.mode("append").parquet(land)
    assert refresh() == {"c1": (2, 10), "c2": (1, 7)}


def test_late_rows_and_open_days(spark, tmp_path):
    land, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    times = ["2024-01-01 10:00:00", "2024-01-01 23:00:00", "2024-01-02 09:00:00"]
    df = spark.createDataFrame([(t, 1) for t in times], "t string, views long").select(
        F.col("t").cast("timestamp_ntz").alias("publish_date"), "views")
    df.write.parquet(land)
    closed = jobs.stream_daily_views(spark, land, out, df.schema, checkpoint=state)
    assert [(str(r.date), r.views) for r in closed.collect()] == [("2024-01-01", 2)]
    # A row of the closed day comes too late; the next day closes.
    late = spark.createDataFrame([("2024-01-01 11:00:00", 9), ("2024-01-03 12:00:00", 1)], "t string, views long").select(
        F.col("t").cast("timestamp_ntz").alias("publish_date"), "views")
    late.write.mode("append").parquet(land)
    closed = jobs.stream_daily_views(spark, land, out, df.schema, checkpoint=state)
    assert sorted((str(r.date), r.views) for r in closed.collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_readers_keep_the_refresh_they_opened(spark, tmp_path):
    land, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    first = spark.createDataFrame([(f"c{i}", i, f"v{i}") for i in range(40)] + [(None, 3, "n")],
                                  "channel_title string, views long, video_id string")
    first = first.withColumn("publish_date", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    first.write.parquet(land)
    opened = jobs.stream_dashboard_refresh(spark, land, out, first.schema, state, buckets=8)
    files = set(opened.inputFiles())
    before = sorted(map(tuple, opened.collect()), key=str)
    assert len(before) == 41
    first.where("channel_title = 'c7' OR channel_title IS NULL").write.mode("append").parquet(land)
    after = jobs.stream_dashboard_refresh(spark, land, out, first.schema, state, buckets=8)
    # The frame opened before the second batch still reads the whole first refresh.
    assert sorted(map(tuple, opened.collect()), key=str) == before
    figures = {r.channel_title: (r.videos, r.total_views) for r in after.collect()}
    assert figures == {**{f"c{i}": (1, i) for i in range(40)}, "c7": (2, 14), None: (2, 6)}
    # Only the buckets of the two channels have new files.
    assert 0 < len(files - set(after.inputFiles())) < len(files)
    # An unfinished refresh is not read.
    (tmp_path / "out" / "manifest" / "99").mkdir()
    assert jobs.read_dashboard(spark, out, after.schema).count() == 41


def test_dedup_forgets_nothing_over_restarts(spark, tmp_path):
    land, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    schema = "video_id string, region string, views long"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        got = jobs.stream_dedup(spark, land, out, spark.createDataFrame([], schema).schema, ["video_id", "region"], state,
                                files_per_batch=1)
        return sorted(((r.video_id, r.region, r.views) for r in got.collect()), key=str)

    first = arrive(("a", "US", 1), (None, "US", 2), ("a", None, 3))
    assert len(first) == 3
    second = arrive(("a", "US", 9), (None, "US", 9), ("a", None, 9), ("a", "GB", 4), ("b", "US", 5), ("b", "US", 5))
    assert second == sorted([*first, ("a", "GB", 4), ("b", "US", 5)], key=str)
    assert arrive(("a", "US", 1)) == second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
