"""One query per operator, run with production parameters over its whole table, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.llm import (
    blocks,
    bpe,
    chat,
    decontaminate,
    html_text,
    interaction,
    language,
    mixing,
    neardup,
    quality,
    runs,
    sharding,
    sql,
    suffixes,
)
from trendmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(twin: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if twin:
            ORACLES[build.__name__] = twin
        return build
    return register


@query()
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return sharded.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"),
                          "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query(sql.OP3)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    drawn = mixing.repetitions(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(sql.OP4)
def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated windows of 35 words."""
    cut = blocks.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(sql.OP5)
def op5_suffix_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier."""
    cut = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return language.identify(docs, language.learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


@query(sql.OP7)
def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    judged = quality.apply_quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "n_removed_words", "base_failed", "kept")


@query(sql.OP8)
def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by shingles of four words."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id",
                        F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


@query(sql.OP9)
def op9_chat_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
        for i, role in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    done = chat.format_chat(chat.canonical_turns(rows.unionByName(probe)))
    turns, loss = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    done = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query(sql.OP10)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rows = hits.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(F.col("__id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"))


@query(sql.OP11)
def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, per language."""
    return interaction.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts they decode to."""
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query(sql.OP13)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, some of them given a periodic tail, and the texts without the repeats."""
    found = runs.collapse_runs(runs.planted_repeats(table(spark, sf_dir, "documents")))
    best = runs.longest_run(F.col("runs"))
    found = found.select("*", best.alias("best"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                        runs.run_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
