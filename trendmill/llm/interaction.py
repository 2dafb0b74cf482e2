"""Audit of how document filters overlap, by contractions of a contingency tensor.

Every document falls into one cell of a tensor with one axis of length two (pass, fail) per
filter.  What any filter removes at any place of any order is a contraction of that tensor with
one vector per axis: pass, fail or all.  Documents are touched once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAPS = r"[\x20\x09-\x0D]+"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_MEASURES = ("documents", "good", "toxic")
_AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long, filter string")


def text_filters(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3,
                 signs: str = r"[#$%&*|]") -> dict[str, Column]:
    """Failure conditions A to D of a non-null text: short, repetitive, shouting, holding signs."""
    words = F.array_remove(F.split(text, _GAPS, -1), "")
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > capital_percent * F.length(text),
        "D": text.rlike(signs),
    }


def contingency(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(part, A, B, C, D, E, documents, good, toxic): the cells that hold documents; a flag is 1 where its filter fails.

    E fails where a smaller id has the same text anywhere in the table.  Null texts are empty and equal
    to each other, a null part is the empty string, a null id is neither smaller nor larger than any
    other and so never fails E, and has no label.  Repeated rows count one by one; rows that share
    id and text share the verdict E.  Several labels of one id: one that says 1 is enough.  Empty
    tables have no cells.  Extra columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    flags = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in text_filters(body).items()}
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(body, 256)).alias("digest"), *(v.alias(k) for k, v in flags.items()))
    # Both joins below are on the id, so that a text with a million copies has no task of its own.
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(1).alias("first"))
    marks = labels.select(F.col(ident).alias("id"), "quality", "toxic").where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    counted = rows.groupBy("id", "digest", "part", *flags).agg(F.count("*").alias("n"))
    joined = counted.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    later = F.col("id").isNotNull() & F.col("first").isNull()
    n = F.col("n")
    return joined.withColumn("E", later.cast("int")).groupBy("part", *flags, "E").agg(
        F.sum(n).alias("documents"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(n * F.coalesce("bad", F.lit(0))).alias("toxic"))


def _selectors(orders: list[str], choose) -> list[np.ndarray]:
    """One (order and step, 2) array per axis; ``choose(place, step)`` gives what an axis selects."""
    names = sorted(orders[0])
    rows = [[choose(order.index(name), step) for name in names] for order in orders for step in range(len(names))]
    return list(np.array(rows, np.int64).transpose(1, 0, 2))


def contract(tensor: np.ndarray, names: str) -> pd.DataFrame:
    """All orders and steps of one part; ``tensor`` is (measures, 2, 2, ...), one axis of two per filter."""
    axes, names = tensor.ndim - 1, "".join(sorted(names))
    orders = ["".join(p) for p in permutations(names)]
    letters = "abcdefghijklmnopqrstuvw"[:axes]
    formula = f"z{letters}," + ",".join(f"x{a}" for a in letters) + "->xz"

    def count(choose) -> np.ndarray:
        return np.einsum(formula, tensor, *_selectors(orders, choose))

    kept = count(lambda place, step: _PASS if place <= step else _ALL)
    removed = count(lambda place, step: _PASS if place < step else _FAIL if place == step else _ALL)
    failing = count(lambda place, step: _FAIL if place == step else _ALL)
    alone = count(lambda place, step: _FAIL if place == step else _PASS)
    out = pd.DataFrame({
        "filter_order": np.repeat(orders, axes), "step": np.tile(np.arange(1, axes + 1, dtype=np.int32), len(orders)),
        "kept": kept[:, 0], "removed": removed[:, 0], "redundant": failing[:, 0] - removed[:, 0],
        "unique_fails": alone[:, 0], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2],
        "filter": [name for order in orders for name in order]})
    out["shapley"] = out.groupby("filter")["removed"].transform("sum")
    return out


def _audit_part(cells: pd.DataFrame, names: str) -> pd.DataFrame:
    tensor = np.zeros((len(_MEASURES),) + (2,) * len(names), np.int64)
    place = tuple(cells[name].to_numpy(np.int64) for name in names)
    for i, measure in enumerate(_MEASURES):
        tensor[(i, *place)] = cells[measure].to_numpy(np.int64)
    out = contract(tensor, names)
    out["part"] = cells["part"].iloc[0]
    return out[[field.split()[0] for field in _AUDIT.split(", ")]]


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per part, order of the filters ABCDE and step: what stays, what goes, and what would have gone anyway.

    One row, zeros included, for each of the 120 orders and 5 steps of each part; ``contingency`` says how
    nulls, repeated rows, ties and empty tables are read.  A group holds at most 32 rows, whatever the part's size.
    """
    cells = contingency(docs, labels, part, text, ident)
    return cells.groupBy("part").applyInPandas(lambda group: _audit_part(group, "ABCDE"), _AUDIT)
