"""A corpus pipeline over ``documents``: rules, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.  Null texts and texts
without words fail the rules; null ids and null sources are values of their own; extra columns pass through all
stages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.llm import decontaminate, mixing, neardup, quality, sharding
from trendmill.llm.common import table
from trendmill.session import materialise

#: run()'s rows depend on xxhash64 keys and on words cut by line hashes, which DuckDB can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines above the limits; n_chars follows the text."""
    judged = quality.apply_quality_rules(docs).where("kept")
    changed = {"text": F.col("cleaned"), "n_chars": F.coalesce(F.length("cleaned").cast("long"), F.lit(0))}
    return judged.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Rows equal in id and text are one document; texts without words all stay."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item, or the whole of a shorter item; repeated rows alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: floor(rate) copies and one more by a draw from id and text.

    A source of null is one of its own; with one source every document stays once."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of near equal bytes, with size, shard and slot; repeated rows share a shard, each has a slot."""
    return sharding.shard_documents(docs, 16)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
