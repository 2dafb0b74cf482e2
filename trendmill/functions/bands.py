"""Turning numbers into labelled bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendmill import constants as K


def band(value: Column, edges, labels, right_closed: bool = False) -> Column:
    """Label of the band ``value`` falls in; null stays null.

    Bands are ``[a, b)`` unless ``right_closed``, then ``(a, b]``.
    """
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge if right_closed else value < edge, label)
    return out.otherwise(labels[-1])


def view_category(views: Column, right_closed: bool = False) -> Column:
    return band(views, *K.VIEW_BANDS, right_closed=right_closed)


def engagement_category(rate: Column, right_closed: bool = False) -> Column:
    return band(rate, *K.ENGAGEMENT_BANDS, right_closed=right_closed)


def trending_speed(hours: Column) -> Column:
    return band(hours, *K.SPEED_BANDS, right_closed=True)


def error_quality(relative_error: Column) -> Column:
    return band(relative_error, *K.ERROR_BANDS, right_closed=True)


def time_of_day(hour: Column, evening_end: int = 23) -> Column:
    """Part of the day; ``evening_end=22`` moves 23h to the night."""
    return (
        F.when(hour.isNull(), F.lit(None).cast("string"))
        .when(hour.between(6, 11), "Morning")
        .when(hour.between(12, 17), "Afternoon")
        .when(hour.between(18, evening_end), "Evening")
        .otherwise("Night")
    )
