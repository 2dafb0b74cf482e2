"""T*: the streaming jobs over landed copies of the tables, compared with the batch result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.adapters import event_videos, trending
from trendmill.operators import quality
from trendmill.plans import landing
from trendmill.plans.quality_queries import _SCORE, checked, suite_sql
from trendmill.plans.registry import query
from trendmill.plans.sqltext import enriched_sql, videos_sql, with_tables
from trendmill.session import scratch_path
from trendmill.sources.files import CATEGORY_DOCUMENT
from trendmill.streaming import jobs


def _land(df, name: str, pieces: int = 0) -> str:
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(pieces) if pieces else df).write.parquet(path)
    return path


@query("stream_json_to_parquet", videos_sql("""
SELECT CASE WHEN c % 11 <> 0 THEN CAST(c AS VARCHAR) END AS id,
  CASE WHEN c % 6 <> 0 THEN 'Topic ' || c END AS snippet_title, c % 2 = 0 AS snippet_assignable,
  'UC' || region_code AS snippet_channelId
FROM (SELECT DISTINCT region_code, category_id AS c FROM videos)"""))
def stream_json_to_parquet(spark, sf):
    path = landing.land_json(landing.category_documents(spark, sf), "categories")
    rows = jobs.stream_json_to_parquet(spark, path, scratch_path(spark, "stream-out"), CATEGORY_DOCUMENT,
                                       multi_line=False)
    return rows.toDF(*[c.replace(".", "_") for c in rows.columns])


_REGIONS = ["US", "GB", "IN", "FR", "XX"]


@query("stream_validate", enriched_sql(" UNION ALL ".join(
    f"SELECT {_SCORE}, (SELECT count(*) FROM rows_{r}) AS record_count FROM ({suite_sql(quality.SUITE, f'rows_{r}')})"
    for r in _REGIONS),
    ",\n".join(f"rows_{r} AS (SELECT * FROM enriched WHERE region_code = '{r}')" for r in _REGIONS)),
       doubles="quality_score:2")
def stream_validate(spark, sf):
    """Each region lands in a folder of as many files as its rows need; a folder's files are one batch."""
    df, path, reports = checked(spark, sf), scratch_path(spark, "stream-in"), []
    for region in _REGIONS:
        df.where(F.col("region_code") == region).write.parquet(f"{path}/{region}")
        reports.append(jobs.stream_validate(spark, f"{path}/{region}", scratch_path(spark, "stream-out"), df.schema, order="seq"))
    return reduce(DataFrame.unionByName, reports).drop("batch")


@query("stream_dashboard_refresh", with_tables("""
SELECT channel_title, count(*) AS videos, CAST(sum(views) AS BIGINT) AS total_views, max(views) AS max_views,
  min(publish_date) AS first_seen, max(publish_date) AS last_seen FROM event_videos GROUP BY 1""", "events"))
def stream_dashboard_refresh(spark, sf):
    df = event_videos(spark, sf)
    return jobs.stream_dashboard_refresh(spark, _land(df, "stream-in"), scratch_path(spark, "stream-out"), df.schema)


@query("stream_daily_views", with_tables("""
SELECT CAST(publish_date AS DATE) AS date, CAST(sum(views) AS BIGINT) AS views, count(*) AS videos
FROM event_videos GROUP BY 1
HAVING CAST(publish_date AS DATE) + 1 <= (SELECT max(publish_date) FROM event_videos) - INTERVAL 1 HOUR""",
    "events"))
def stream_daily_views(spark, sf):
    """Days the watermark has closed; the last day is still open."""
    df = event_videos(spark, sf)
    return jobs.stream_daily_views(spark, _land(df, "stream-in"), scratch_path(spark, "stream-out"), df.schema)


@query("stream_dedup", with_tables("SELECT DISTINCT video_id FROM trending", "trending"))
def stream_dedup(spark, sf):
    """Raw rows arrive in any order here; every key is kept once, as in the batch job."""
    df = trending(spark, sf)
    out = jobs.stream_dedup(spark, _land(df, "stream-in"), scratch_path(spark, "stream-out"), df.schema, ["video_id"])
    return out.select("video_id")
