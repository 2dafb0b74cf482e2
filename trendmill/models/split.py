"""Repeatable train/test splits that need no sort of a whole class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill.operators.ranks import null_safe_join, values_at_ranks


def draw(key: str, seed: int) -> Column:
    """A 48-bit number per key, the same in every run and on every engine with md5."""
    digest = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def mark_train(df: DataFrame, key: str, label: str | None = None, share: float = 0.8,
               seed: int = 42, few: bool = False) -> DataFrame:
    """Adds ``is_train``: the ``share`` of rows (of each label) with the smallest draws.

    The cut is the exact order statistic of the draws per label, found by
    counting (see ``operators.ranks``); a label that owns most rows is never
    gathered.  Rows that share a key share a side.  ``few``: the labels are a
    bounded list, so the cuts may be broadcast.
    """
    keys = [label] if label else []
    drawn = df.withColumn("_draw", draw(key, seed))

    def last_train_row(n: Column) -> Column:
        rank = F.greatest(F.round(n * F.lit(share)).cast("long") - 1, F.lit(0))
        return F.array(F.struct(F.lit("cut").alias("tag"), rank.alias("rank")))

    cuts = values_at_ranks(drawn, keys, "_draw", last_train_row, few)
    if not keys:
        return drawn.withColumn("is_train", F.col("_draw") <= cuts.select("value").scalar()).drop("_draw")
    cuts = cuts.select(*keys, F.col("value").alias("_cut"))
    return (null_safe_join(drawn, cuts, keys, small=few).withColumn("is_train", F.col("_draw") <= F.col("_cut"))
            .drop("_draw", "_cut"))


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` for cross-validation, from the same draw."""
    return df.withColumn("fold", F.pmod(draw(key, seed + 1), F.lit(folds)).cast("int"))
