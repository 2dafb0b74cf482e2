"""Tables the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.adapters import videos
from trendmill.models.crossfit import cross_fitted_predictions
from trendmill.operators.enrich import analytics_columns
from trendmill.session import materialise

_SCORES: dict[tuple, DataFrame] = {}


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytics table: videos and derived columns."""
    return (
        videos(spark, sf_dir)
        .transform(analytics_columns)
        .withColumn("extracted_at", F.timestamp_add("DAY", F.lit(1), F.col("publish_date")))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all videos by models that did not see them; a table that a session writes once per data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORES:
        _SCORES[key] = materialise(cross_fitted_predictions(enriched(spark, sf_dir)), "predictions")
    return _SCORES[key]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytics table with its prediction columns."""
    return enriched(spark, sf_dir).join(predictions(spark, sf_dir), "video_id", "left")
