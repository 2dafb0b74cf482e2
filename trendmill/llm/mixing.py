"""Mixing sources to target weights by whole repetitions and a seeded last copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendmill.llm.common import word_count
from trendmill.session import materialise


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources ordered by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``cap`` times its source's size and the rest is shared again.  Sources
    sorted by cap per weight are capped from the front as long as the level that the others would
    get is above theirs, so running sums give the fixed point.  One row per source goes into one
    task; documents do not.  Sums are exact as long as total words times the weights fit a long.
    """
    everything = Window.partitionBy()
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", w.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = weighed.withColumns({"left": left, "rest": rest})
    over = F.col("left") * F.col("w") > cap * F.col("source_size") * F.col("rest")
    capped = F.min(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    levels = levels.withColumn("capped", capped)
    # The first source that is not capped has the level; later ones would read lower, wrong ones.
    first = F.min_by(F.col("left").cast("double") / F.col("rest").cast("double"),
                     F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(),
                                                       F.col("source"))))
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(
        F.col("__level") * F.col("w").cast("double"))
    return (levels.withColumn("__level", first.over(everything))
            .select("source", "source_size", target.alias("target")))


def uniform(seed: int, *columns):
    """A repeatable number in [0, 1) from 52 bits of a digest of the columns."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def repetitions(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11,
                text: str = "text", source: str = "source", ident: str = "doc_id") -> DataFrame:
    """``docs`` with size (words), source_size, target, rate and copies.

    copies = floor(rate) plus one with the rate's fraction as probability, drawn from a digest of
    seed, id and text: reruns agree, and rows equal in both draw alike.  Null text has size 0, null
    source is a source of its own, a source without words has rate 0.  Input columns with these
    names are replaced.  An empty table gives no rows.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    docs = docs.drop(*added)
    sized = docs.withColumn("size", word_count(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    # Written once: its known size lets Spark decide between broadcast and shuffle join.
    targets = materialise(source_targets(materialise(sizes, "sizes"), weights, cap), "targets")
    targets = targets.withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"),
                                                    F.lit(float(cap)))).otherwise(F.lit(0.0))
    whole = F.floor(F.col("rate"))
    extra = uniform(seed, F.col(ident), F.col(text)) < F.col("rate") - whole
    return (sized.join(targets, sized[source].eqNullSafe(targets["__source"]), "left")
            .withColumn("rate", rate).withColumn("copies", (whole + extra.cast("int")).cast("int"))
            .select(*docs.columns, *added))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with ``docs``'s columns."""
    drawn = repetitions(docs, **options)
    return (drawn.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
            .select(*[c for c in docs.columns if c in drawn.columns]))
