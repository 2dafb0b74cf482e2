"""Files as the outside world would land them, written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import table, videos
from trendmill.session import scratch_path

PAGE = 50  # items per API response


def _pages(items: DataFrame, number: Column, *by) -> DataFrame:
    """Documents ``{items: [...]}`` of at most a page of consecutive items."""
    return items.groupBy(F.floor(number / PAGE).alias("page"), *by).agg(
        F.collect_list("item").alias("items")).drop("page")


def video_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = videos(spark, sf_dir)
    seq = F.col("seq")
    item = F.struct(
        F.col("video_id").alias("id"),
        F.struct(
            "title", "description",
            F.when(seq % 4 != 0, F.split("tags", "[|]")).alias("tags"),
            F.when(seq % 8 != 0, F.col("category_id").cast("string")).alias("categoryId"),
            F.col("channel_id").alias("channelId"), F.col("channel_title").alias("channelTitle"),
            F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.struct(F.struct(F.concat(F.lit("http://img/"), "video_id").alias("url")).alias("high"))
            .alias("thumbnails")).alias("snippet"),
        F.struct(F.col("views").cast("string").alias("viewCount"), F.col("likes").cast("string").alias("likeCount"),
                 F.col("comments").cast("string").alias("commentCount")).alias("statistics"),
        F.struct("duration", F.lit("hd").alias("definition"), F.lit("false").alias("caption"),
                 F.when(seq % 3 != 0, seq % 3 == 1).alias("licensedContent"),
                 F.lit("rectangular").alias("projection")).alias("contentDetails"),
        F.struct(F.lit("processed").alias("uploadStatus"), F.lit("public").alias("privacyStatus")).alias("status"))
    return _pages(df.select("seq", item.alias("item")), F.col("seq"))


def category_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: the categories its videos use, some without title or id."""
    seen = videos(spark, sf_dir).select("region_code", "category_id").distinct()
    cid = F.col("category_id")
    item = F.struct(
        F.when(cid % 11 != 0, cid.cast("string")).alias("id"),
        F.struct(F.when(cid % 6 != 0, F.concat(F.lit("Topic "), cid)).alias("title"),
                 (cid % 2 == 0).alias("assignable"),
                 F.concat(F.lit("UC"), "region_code").alias("channelId")).alias("snippet"))
    # At most a few dozen categories per region.
    return seen.select("region_code", item.alias("item")).groupBy("region_code").agg(
        F.collect_list("item").alias("items"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), K.SEARCH_VIDEO_KIND).otherwise("other#channel")
    item = F.struct(F.struct(kind.alias("kind"), F.concat(F.lit("e"), "event_id").alias("videoId")).alias("id"))
    return _pages(events.select("event_id", item.alias("item")), F.col("event_id"))


def land_json(documents: DataFrame, name: str) -> str:
    path = scratch_path(documents.sparkSession, name)
    documents.write.json(path)
    return path


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the regional CSV files; some descriptions hold line breaks and quotes."""
    df, seq = videos(spark, sf_dir), F.col("seq")
    return df.select(
        "video_id", "title", "channel_title", F.col("category_id").cast("string").alias("category_id"),
        F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("publish_time"), "tags",
        F.col("views").cast("string").alias("views"), F.col("likes").cast("string").alias("likes"),
        F.lit("0").alias("dislikes"), F.col("comments").cast("string").alias("comment_count"),
        F.concat(F.lit("http://img/"), "video_id").alias("thumbnail_link"),
        F.when(seq % 9 == 2, 'first line\nsaid "hi", then left').otherwise(F.col("description")).alias("description"),
        F.concat("region_code", F.lit("videos.csv")).alias("file"))


def land_regions(spark: SparkSession, sf_dir: str) -> str:
    """``..=USvideos.csv`` folders, one per region; ``XX`` is one the loader does not know."""
    folder = scratch_path(spark, "regions")
    (region_rows(spark, sf_dir).hint("rebalance", "file").write.partitionBy("file")
     .option("header", True).option("escape", '"').csv(folder))
    return folder


def land_mixed_regions(spark: SparkSession, sf_dir: str) -> str:
    """Regions as different providers land them: FR with its columns in another order and one more, GB without a
    ``views`` column, IN without quotes, so a comma in its tags begins a field too many."""
    folder, rows = scratch_path(spark, "mixed-regions"), region_rows(spark, sf_dir).hint("rebalance", "file")
    head = [c for c in rows.columns if c != "file"]
    shapes = {"US": head, "FR": ["trending_date", *reversed(head)], "GB": [c for c in head if c != "views"], "IN": head}
    for region, columns in shapes.items():
        own = rows.where(F.col("file") == f"{region}videos.csv").withColumn("trending_date", F.lit("23.01.02"))
        if region == "IN":
            own = own.withColumn("description", F.lit("plain"))
        quote = "" if region == "IN" else '"'
        own.select(*columns).write.option("header", True).option("escape", '"').option("quote", quote).csv(
            f"{folder}/{region}videos.csv")
    return folder
