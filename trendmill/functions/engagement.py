"""Rates and scores over views, likes and comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(top: Column, bottom: Column, otherwise=0.0) -> Column:
    """``top / bottom`` where bottom is positive, else ``otherwise``; null in, null out."""
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise))
    return (
        F.when(bottom > 0, top.cast("double") / bottom.cast("double"))
        .when(bottom.isNotNull(), fallback.cast("double"))
    )


def engagement_rate(likes: Column, comments: Column, views: Column,
                    zero_views_as_one: bool = False) -> Column:
    if zero_views_as_one:
        return (likes + comments).cast("double") / F.when(views == 0, 1).otherwise(views)
    return safe_ratio(likes + comments, views)


def like_to_comment_ratio(likes: Column, comments: Column) -> Column:
    return safe_ratio(likes, comments, otherwise=likes)


def engagement_score(likes: Column, comments: Column, rate: Column) -> Column:
    return F.log1p(likes) * 0.5 + F.log1p(comments) * 0.3 + rate * 0.2
