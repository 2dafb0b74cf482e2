"""Calendar parts, cyclical encodings and elapsed time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column, mode: str = "exact") -> Column:
    """Hours from ``start`` to ``end``.

    ``exact`` measures to the second and never goes below zero; ``days`` counts
    calendar days times 24 and may be negative.
    """
    if mode == "days":
        return F.date_diff(end, start) * F.lit(24.0)
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(micros / F.lit(3.6e9), F.lit(0.0)))


def monday_weekday(ts: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(ts)


def calendar(ts: Column, prefix: str = "publish") -> dict[str, Column]:
    return {
        f"{prefix}_hour": F.hour(ts),
        f"{prefix}_day_of_week": monday_weekday(ts),
        f"{prefix}_day_of_month": F.dayofmonth(ts),
        f"{prefix}_week": F.weekofyear(ts),
        f"{prefix}_month": F.month(ts),
        f"{prefix}_quarter": F.quarter(ts),
        f"{prefix}_year": F.year(ts),
    }


def cyclical(ts: Column, prefix: str = "publish") -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month, each over its own period."""
    parts = {"hour": (F.hour(ts), 24), "day": (monday_weekday(ts), 7), "month": (F.month(ts), 12)}
    out = {}
    for name, (value, period) in parts.items():
        angle = value * F.lit(2 * math.pi / period)
        out[f"{prefix}_{name}_sin"] = F.sin(angle)
        out[f"{prefix}_{name}_cos"] = F.cos(angle)
    return out


def time_flags(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "is_weekend": (monday_weekday(ts) >= 5).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
        "is_prime_time": hour.between(19, 23).cast("int"),
    }
