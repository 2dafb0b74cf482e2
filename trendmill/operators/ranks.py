"""Exact order statistics without sorting a whole group in one task.

A value's bin is a fixed, non-decreasing function of the value (its position on
a logarithmic scale).  Counting rows per bin is a map-side-combined aggregate
that ships a bounded number of rows per group; running totals over the bins say
which bin holds a wanted rank.  Only rows of those bins, first collapsed to
(value, count), are put in order.  A group or a single value that owns a third
of all rows is therefore never gathered: it is a handful of counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins per doubling of the magnitude; a coarse bin spans COARSE fine bins.
FINE_BINS = 8192
COARSE = 512


# Doubles reach down to 2^-1074; the shift keeps every magnitude's level above zero.
_SHIFT = 1080.0
_INFINITE, _NAN = 1 << 40, (1 << 40) + 1


def bin_of(value: Column) -> Column:
    """Monotone bin number of a numeric value; 0, NaN and the infinities have bins of their own.

    NaN is above +infinity, as it is in Spark's order.
    """
    number = value.cast("double")

    def magnitude(v: Column) -> Column:
        level = F.floor((F.log2(v) + F.lit(_SHIFT)) * FINE_BINS).cast("long")
        return F.greatest(level, F.lit(0)) + F.lit(1)

    return (
        F.when(F.isnan(number), F.lit(_NAN))
        .when(number == float("inf"), F.lit(_INFINITE))
        .when(number == float("-inf"), F.lit(-_INFINITE))
        .when(number > 0, magnitude(number))
        .when(number < 0, -magnitude(-number))
        .when(number == 0, F.lit(0).cast("long"))
    )


def _running_bins(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n) with ``before``: rows of the group in lower bins.

    Two short windows - over coarse bins, then over the fine bins inside each -
    keep every window partition at about a thousand rows.
    """
    coarse = counts.withColumn("coarse", F.floor(F.col("bin") / COARSE))
    totals = coarse.groupBy(*keys, "coarse").agg(F.sum("n").alias("coarse_n"))
    upto = Window.partitionBy(*keys).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = totals.select(
        *keys, "coarse",
        F.coalesce(F.sum("coarse_n").over(upto), F.lit(0)).alias("coarse_before"),
        F.sum("coarse_n").over(whole).alias("group_n"))
    inner = (Window.partitionBy(*keys, "coarse").orderBy("bin")
             .rowsBetween(Window.unboundedPreceding, -1))
    fine = coarse.withColumn("inner_before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    on = [*keys, "coarse"]
    joined = fine.join(totals, on) if not keys else null_safe_join(fine, totals, on)
    return joined.withColumn("before", F.col("coarse_before") + F.col("inner_before"))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                    small: bool = False) -> DataFrame:
    """Equi-join in which null keys meet; keeps the left side's key columns.

    ``small`` broadcasts the right side: only for sides of a known bound.
    """
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    if small:
        renamed = F.broadcast(renamed)
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__{c}" for c in on])


def values_at_ranks(df: DataFrame, keys: list[str], value: str, positions, few: bool = False) -> DataFrame:
    """The value at given 0-based ranks of every group, nulls left out.

    ``positions(n)`` maps the group's row count to an array column of structs
    ``(tag, rank)``.  Returns ``keys, tag, rank, value, group_n``.

    ``few`` says that the caller knows the number of groups to be bounded (a
    fixed list of labels, say): then the wanted bins are a handful of rows and
    are broadcast, and the data is not shuffled to look them up.  Without groups
    that holds by itself; otherwise the join is left to AQE.
    """
    few = few or not keys
    known = df.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull())
    known = known.withColumn("bin", bin_of(F.col("value")))
    bins = known.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    running = _running_bins(bins, keys)
    wanted = (
        running.withColumn("want", F.explode(positions(F.col("group_n"))))
        .where((F.col("want.rank") >= F.col("before"))
               & (F.col("want.rank") < F.col("before") + F.col("n")))
        .select(*keys, "bin", "group_n", "before", F.col("want.tag").alias("tag"),
                F.col("want.rank").alias("rank"))
    )
    on = [*keys, "bin"]
    # One row per (group, bin) that matters: a few rows per group.
    targets = wanted.groupBy(*on).agg(
        F.min("group_n").alias("group_n"), F.min("before").alias("before"),
        F.collect_list(F.struct("tag", "rank")).alias("wants"))
    counted = (
        null_safe_join(known, targets.select(*on), on, "left_semi", small=few)
        .groupBy(*on, "value").agg(F.count("*").alias("n"))
    )
    inside = Window.partitionBy(*on).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ordered = counted.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (
        null_safe_join(ordered, targets, on)
        .withColumn("want", F.explode("wants"))
        .withColumn("low", F.col("before") + F.col("lower"))
        .where((F.col("want.rank") >= F.col("low")) & (F.col("want.rank") < F.col("low") + F.col("n")))
        .select(*keys, F.col("want.tag").alias("tag"), F.col("want.rank").alias("rank"),
                "value", "group_n")
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    few: bool = False) -> DataFrame:
    """One row per group with a column per named probability (linear interpolation)."""
    def positions(n: Column) -> Column:
        wants = []
        for name, p in probs.items():
            at = (n - 1) * F.lit(float(p))
            wants += [F.struct(F.lit(f"{name}:lo").alias("tag"), F.floor(at).cast("long").alias("rank")),
                      F.struct(F.lit(f"{name}:hi").alias("tag"), F.ceil(at).cast("long").alias("rank"))]
        return F.array(*wants)

    found = values_at_ranks(df, keys, value, positions, few)
    outs = []
    for name, p in probs.items():
        at = (F.max("group_n") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("tag") == f"{name}:lo", F.col("value"))).cast("double")
        high = F.max(F.when(F.col("tag") == f"{name}:hi", F.col("value"))).cast("double")
        outs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.groupBy(*keys).agg(*outs)


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: ``column`` plus one column per probability."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    return exact_quantiles(long, ["column"], "value", probs, few=True)


def prefix_totals(counts: DataFrame, value: str, amounts: list[str]) -> DataFrame:
    """For distinct ``value`` rows: total of each amount over all smaller values (``<amount>_below``).

    Same bins as above, so no window spans the whole data.
    """
    binned = counts.withColumn("bin", bin_of(F.col(value)))
    binned = binned.withColumn("coarse", F.floor(F.col("bin") / COARSE))
    coarse = binned.groupBy("coarse").agg(*[F.sum(a).alias(a) for a in amounts])
    fine = binned.groupBy("coarse", "bin").agg(*[F.sum(a).alias(a) for a in amounts])
    # The coarse table has at most a few thousand rows, whatever the data size.
    over_coarse = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    over_fine = Window.partitionBy("coarse").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("coarse", "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)

    def before(frame, window, tag):
        return frame.select(
            *[c for c in frame.columns if c not in amounts],
            *[F.coalesce(F.sum(a).over(window), F.lit(0)).alias(f"{a}_{tag}") for a in amounts])

    rows = binned.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"{a}_in")
                                for a in amounts])
    rows = (rows.join(before(fine, over_fine, "fine"), ["coarse", "bin"])
            .join(before(coarse, over_coarse, "coarse"), "coarse"))
    below = {f"{a}_below": F.col(f"{a}_in") + F.col(f"{a}_fine") + F.col(f"{a}_coarse") for a in amounts}
    return rows.withColumns(below).select(*counts.columns, *below)
