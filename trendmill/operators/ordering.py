"""Checks that depend on row order, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_breaks(df: DataFrame, order: str, value: Column, span: int = 1 << 20,
                 by: list[str] | None = None) -> DataFrame:
    """How often ``value`` is smaller than the value before it, by a whole-number ``order``.

    Rows that share an order number are reduced to their smallest and largest
    value (within a tie the rows may stand in ascending order), so a hot order
    number is one row.  Order numbers are cut into segments of ``span``; ``lag``
    runs inside a segment, and only each segment's ends are compared across.
    One row, or one per ``by`` group with values: ``checked`` (non-null values) and ``breaks``.
    """
    by = by or []
    known = df.select(*by, F.col(order).alias("o"), value.alias("v")).where("v IS NOT NULL AND o IS NOT NULL")
    steps = known.groupBy(*by, "o").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                   F.count("*").alias("n"))
    steps = steps.withColumn("segment", F.floor(F.col("o") / span))
    inside = Window.partitionBy(*by, "segment").orderBy("o")
    seen = steps.withColumn("prev", F.lag("hi").over(inside))
    ends = seen.groupBy(*by, "segment").agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("lo") < F.col("prev")).alias("breaks"),
        F.min_by("lo", "o").alias("first_lo"), F.max_by("hi", "o").alias("last_hi"))
    # One row per segment of a million order numbers.
    across = ends.withColumn("prev", F.lag("last_hi").over(Window.partitionBy(*by).orderBy("segment")))
    return across.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.col("breaks") + (F.coalesce(F.col("first_lo") < F.col("prev"), F.lit(False)))
                         .cast("long")), F.lit(0)).alias("breaks"))
