"""The dashboard's filter bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_days(df: DataFrame, days: int, column: str = "publish_date") -> DataFrame:
    """Rows of the last ``days`` days up to the latest date in the data."""
    latest = df.agg(F.max(column)).scalar()
    return df.where(F.col(column) >= latest - F.make_dt_interval(F.lit(days)))


def apply_dashboard_filters(df: DataFrame, days: int | None = None, dates=None, categories=None,
                            regions=None, age_groups=None, views=None, engagement=None) -> DataFrame:
    """Every filter is optional; those given must all hold.

    Plain comparisons, so that Spark can prune partitions and push them into the scan.
    """
    if categories:
        df = df.where(F.col("category_id").isin(*categories))
    if regions:
        df = df.where(F.col("region_code").isin(*regions))
    if age_groups:
        df = df.where(F.col("age_group").isin(*age_groups))
    for column, bounds in (("publish_date", dates), ("views", views), ("engagement_rate", engagement)):
        if bounds:
            low, high = bounds
            if low is not None:
                df = df.where(F.col(column) >= low)
            if high is not None:
                df = df.where(F.col(column) <= high)
    return trailing_days(df, days) if days else df
