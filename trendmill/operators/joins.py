"""Category enrichment, score alignment and dense calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill import constants as K


def category_dimension(spark: SparkSession) -> DataFrame:
    """The fixed category table (fifteen rows), with a size Spark can see."""
    rows = [F.struct(F.lit(cid).alias("category_id"), F.lit(title).alias("category_title"))
            for cid, title in K.CATEGORY_TITLES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def enrich_with_category(df: DataFrame, categories: DataFrame, how: str = "left") -> DataFrame:
    """Statistics joined to a category table on ``category_id``.

    No broadcast hint: Spark broadcasts the table if its size allows and AQE
    splits a hot category if it does not.
    """
    return df.join(categories, "category_id", how)


def category_name_lookup(df: DataFrame, categories: DataFrame, default: str | None = "Other",
                         prefix: str | None = None) -> DataFrame:
    """``category_name`` with a default, or ``<prefix> <id>`` when a prefix is given."""
    fallback = F.concat_ws(" ", F.lit(prefix), "category_id") if prefix else F.lit(default)
    return (
        df.join(categories, "category_id", "left")
        .withColumn("category_name", F.coalesce("category_title", fallback))
        .drop("category_title")
    )


def align_predictions(df: DataFrame, scores: DataFrame, defaults: dict, key: str = "video_id") -> DataFrame:
    """Scores brought back to every input row; rows without one get ``defaults`` (or null)."""
    out = df.join(scores, key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None}
    return out.withColumns(filled) if filled else out


def dense_hour_join(by_hour: DataFrame, hour: str, value: str) -> DataFrame:
    """All 24 hours; an hour without rows gets 0."""
    slots = by_hour.sparkSession.range(24).select(F.col("id").cast("int").alias(hour))
    return slots.join(by_hour, hour, "left").select(
        hour, F.format_string("%02d:00", hour).alias("label"),
        F.coalesce(value, F.lit(0.0)).alias(value))
