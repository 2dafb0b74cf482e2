"""Benchmark decontamination by word windows; DataFrame expressions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill.session import materialise

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows whose width and hash may be broadcast, some 3 MB. Beyond that Spark chooses the join by size.
BROADCAST_WINDOWS = 100_000


def normalised_words(text: Column) -> Column:
    """Words of [0-9a-z] and non-ASCII signs, after A-Z became a-z; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _GAPS, -1), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10, text: str = "text", ident: str = "item_id") -> DataFrame:
    """(width, key, words, items): the distinct windows, their hash, and the ids of the items that have them."""
    words = benchmark.select(F.col(ident).cast("string").alias("item"), normalised_words(F.col(text)).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(width)))
    cut = words.select("item", "width", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("width") + 1),
        lambda i: F.slice("words", i, F.col("width")))).alias("words"))
    return (cut.groupBy("width", "words").agg(F.collect_set("item").alias("items"))
            .select("width", F.xxhash64("words").alias("key"), F.col("words").alias("window"), "items"))


def _probe(words: Column, width: int):
    # Single words are picked: a slice would copy the whole array each time.
    return lambda i: F.struct(i.alias("at"), F.lit(width).alias("w"),
                              F.xxhash64(F.array(*(F.get(words, i + j) for j in range(width)))).alias("k"))


def _probes(words: Column, widths: list[int]) -> Column:
    """(at, w, k): each window's place, width and hash, and first the document itself at -1 with its number of words."""
    itself = F.struct(F.lit(-1).alias("at"), F.size(words).alias("w"), F.lit(0).cast("long").alias("k"))
    none = F.array().cast("array<struct<at:int,w:int,k:bigint>>")
    windows = [F.when(F.size(words) >= w, F.transform(
        F.sequence(F.lit(0), F.size(words) - w),
        _probe(words, w)
    )).otherwise(none) for w in widths]
    return F.concat(F.array(itself), *windows)


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", ident: str = "doc_id",
              bench_text: str = "text", bench_ident: str = "item_id") -> DataFrame:
    """One row per distinct (id, text) of ``docs``: __id, __content, copies, n_words, hits, items.

    hits are the 0-based word positions inside any occurrence of a window; items the benchmark items
    whose windows occur, ordered as strings.  Every window of every document is looked up by hash in
    the benchmark's windows and those found are verified word by word.  Null and empty texts have no
    words and no hits, null ids are a value like any other, repeated rows count as copies, items
    without words have no windows, and empty tables give no rows or no hits.  Rows of single words
    hold a place and a hash, never the words, so memory grows in proportion to a text's length.
    """
    windows = materialise(benchmark_windows(benchmark, width, bench_text, bench_ident), "windows")
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # at most ``width`` values
    known = windows.select(F.col("width").alias("w"), F.col("key").alias("k"), "window", "items")
    keys = known.select("w", "k").distinct().withColumn("seen", F.lit(True))
    if windows.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    texts = docs.select(F.col(ident).alias("__id"), F.xxhash64(text).alias("__content"), F.col(text).alias("__text"))
    words = texts.select("__id", "__content", normalised_words(F.col("__text")).alias("words"))
    probes = words.select("__id", "__content", F.inline(_probes(F.col("words"), widths)))
    looked = probes.join(keys, ["w", "k"], "left").where((F.col("at") < 0) | F.col("seen"))
    place = F.struct("at", "w", "k")
    found = materialise(looked.groupBy("__id", "__content").agg(
        F.count_if(F.col("at") < 0).alias("copies"), F.max(F.when(F.col("at") < 0, F.col("w"))).alias("n_words"),
        F.collect_set(F.when(F.col("at") >= 0, place)).alias("places")), "hits")
    asked = found.where(F.size("places") > 0).select(F.col("__id").alias("__own"), F.col("__content").alias("__same"), "places")
    same = F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__content") == F.col("__same"))
    # Texts without a place are gone before the others meet their places; the sets below see repeated rows once.
    met = texts.join(asked.select("__own", "__same"), same, "left_semi").join(asked, same)
    met = met.select("__id", "__content", "places", normalised_words(F.col("__text")).alias("words"))
    met = met.select("__id", "__content", F.inline(F.transform("places", lambda p: F.struct(
        p["at"].alias("at"), p["w"].alias("w"), p["k"].alias("k"),
        F.transform(F.sequence(F.lit(0), p["w"] - 1), lambda j: F.get("words", p["at"] + j)).alias("window")))))
    sure = met.join(known, ["w", "k", "window"]).groupBy("__id", "__content").agg(
        F.collect_set(F.struct("at", "w")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["at"], s["at"] + s["w"] - 1)))))
    sure = sure.select(F.col("__id").alias("__own"), F.col("__content").alias("__same"), covered.alias("hits"),
                       F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    rows = found.join(sure, same, "left")
    return rows.select("__id", "__content", "copies", F.col("n_words").cast("long").alias("n_words"),
                       F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_words(text: Column, hits: Column) -> Column:
    """The text without the words at the hit positions and the signs before each."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"),
                                  F.lit(0))
    return F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(hits, i)), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents",
                  text: str = "text", ident: str = "doc_id", **bench) -> DataFrame:
    """``docs`` without the contaminated documents, or, with ``remove='spans'``, without the hit words.

    Null texts have no words and stay.  Repeated rows are judged alike.  An empty benchmark removes
    nothing; an empty table gives no rows.  Items shorter than ``width`` words are one window.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    hits = find_hits(docs, benchmark, width, text, ident, **bench).where(F.size("hits") > 0)
    hits = hits.select(F.struct(F.col("__id").alias("id"), F.col("__content").alias("content"), "hits").alias("__hit"))
    # The documents travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct("*").alias("__doc"))
    same = (F.col(f"__doc.`{ident}`").eqNullSafe(F.col("__hit.id"))
            & (F.xxhash64(F.col(f"__doc.`{text}`")) == F.col("__hit.content")))
    if remove == "documents":
        return rows.join(hits, same, "left_anti").select("__doc.*")
    found = rows.join(hits, same, "left")
    cut = F.when(F.col("__hit").isNull(), F.col(f"__doc.`{text}`")).otherwise(
        without_words(F.col(f"__doc.`{text}`"), F.col("__hit.hits")))
    return found.select(*((cut if c == text else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns))
