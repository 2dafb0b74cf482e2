"""Maximal periodic runs of words, found through a dictionary of basic factors.

Level k of the dictionary names every stretch of 2^k words; equal stretches of one text share a
name, and stretches that occur once have none.  A run with smallest period q holds at its start a
stretch of 2^k <= q < 2^(k+1) words and again q words later.  Occurrences of one name that follow
each other within half their length form an arithmetic progression (a block); the distances between
blocks up to twice the length are proposed as periods, extended both ways and deduplicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill.llm.common import chunks

_GAPS = r"[\x20\x09-\x0D]+"
_MIN_LENGTH = 12
_FOUND = "n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _names(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of equal values, and whether each value occurs more than once."""
    _, name, count = np.unique(values, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def _factors(text: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """Levels of the dictionary: for each place the name of its stretch of 2^k words, -1 where it occurs once."""
    level = np.full(len(code), -1, np.int64)
    name, twice = _names(code * (int(text[-1]) + 1) + text if len(code) else code)
    level[twice] = name[twice]
    levels, width = [level], 1
    while True:
        here = np.flatnonzero(level[:-width] >= 0) if len(level) > width else np.zeros(0, np.int64)
        here = here[(level[here + width] >= 0) & (text[here] == text[here + width])]
        if not len(here):
            return levels
        name, twice = _names(level[here] * len(code) + level[here + width])
        level = np.full(len(code), -1, np.int64)
        level[here[twice]] = name[twice]
        if not twice.any():
            return levels
        levels.append(level)
        width *= 2


def _proposals(level: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods in [width, 2 * width): the place's stretch occurs again one period later."""
    place = np.flatnonzero(level >= 0)
    order = np.argsort(level[place], kind="stable")
    place, name = place[order], level[place[order]]
    if not len(place):
        return place, place
    gap = np.diff(place)
    heads = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (2 * gap > width)))
    sizes = np.diff(np.append(heads, len(place)))
    first, last, own = place[heads], place[heads + sizes - 1], name[heads]
    step = np.zeros(len(heads), np.int64)
    many = sizes > 1
    step[many] = gap[heads[many]]
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for hop in (1, 2, 3):  # a fourth block starts at least twice the width later
        if len(heads) <= hop:
            break
        same = np.flatnonzero(own[:-hop] == own[hop:])
        nearest = first[same + hop] - last[same]
        same, nearest = same[nearest < 2 * width], nearest[nearest < 2 * width]
        stride = np.maximum(np.maximum(step[same], step[same + hop]), 1)
        steps = np.minimum(sizes[same] + sizes[same + hop] - 2, (2 * width - 1 - nearest) // stride)
        skip = np.maximum(0, -((nearest - width) // stride))  # distances below the width belong to other levels
        count = np.maximum(steps - skip + 1, 0)
        row = np.repeat(np.arange(len(same)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + skip[row]
        back = np.minimum(nth, sizes[same][row] - 1)
        places.append(last[same][row] - back * stride[row])
        periods.append(nearest[row] + nth * stride[row])
    return np.concatenate(places), np.concatenate(periods)


def _extend(levels: list[np.ndarray], text: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the longest stretches around ``place`` that keep ``period``; names are compared, not words."""
    size = len(text)
    code = levels[0]
    end, start = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        moving = np.arange(len(place))
        while len(moving):  # to the right: end is the first place not yet known to match
            at = end[moving]
            ok = at + period[moving] + width <= size
            moving, at = moving[ok], at[ok]
            other = at + period[moving]
            ok = (level[at] >= 0) & (level[at] == level[other]) & (text[at] == text[other])
            moving = moving[ok]
            end[moving] += width
        moving = np.arange(len(place))
        while len(moving):
            at = start[moving] - width
            moving, at = moving[at >= 0], at[at >= 0]
            other = at + period[moving]
            ok = (level[at] >= 0) & (level[at] == level[other]) & (text[at] == text[other])
            moving = moving[ok]
            start[moving] -= width
    assert (code[start] >= 0).all()
    return start, end + period


def find_periodic(text: np.ndarray, code: np.ndarray, min_length: int = _MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least ``min_length`` words and two periods.

    ``text`` numbers the text of each word, ascending; ``code`` is equal for equal words.  Ordered by start,
    then period.
    """
    none = np.zeros(0, np.int64)
    if not len(code):
        return none, none, none
    levels = _factors(text, code)
    places, periods = [none], [none]
    for k, level in enumerate(levels):
        place, period = _proposals(level, 1 << k)
        order = np.lexsort((place, period))  # neighbours with one period are one stretch
        place, period = place[order], period[order]
        fresh = np.append(True, (np.diff(period) != 0) | (np.diff(place) > 1 << k)) if len(place) else np.zeros(0, bool)
        places.append(place[fresh])
        periods.append(period[fresh])
    place, period = np.concatenate(places), np.concatenate(periods)
    if not len(place):
        return none, none, none
    start, end = _extend(levels, text, place, period)
    keep = end - start >= np.maximum(min_length, 2 * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))  # of equal stretches the one with the smallest period stays
    start, end, period = start[order], end[order], period[order]
    if len(start):
        fresh = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))
        start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _runs(batches: Iterator[pa.RecordBatch], keep: list[str], min_length: int) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for piece in chunks(batch, "__text"):
            words = [(t or "").encode().split() for t in piece.column("__text").to_pylist()]
            size = np.array([len(w) for w in words], np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            flat = [w for own in words for w in own]
            code = pd.factorize(np.array(flat, object))[0].astype(np.int64)
            text = np.repeat(np.arange(len(words)), size)
            start, length, period = find_periodic(text, code, min_length)
            change = np.zeros(len(flat) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            owner = np.searchsorted(first, start, "right") - 1
            bounds = np.searchsorted(owner, np.arange(len(words) + 1))
            collapsed = [b" ".join(w if a == b else [x for x, lost in zip(w, gone[at:at + len(w)]) if not lost]).decode()
                         for w, at, a, b in zip(words, first, bounds, bounds[1:])]
            found = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(length), pa.array(period)],
                                               fields=list(struct))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in keep), pa.array(size), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), pa.array(collapsed, pa.string())],
                [*keep, "n_words", "n_runs", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                  min_length: int = _MIN_LENGTH) -> DataFrame:
    """``keep`` (default doc_id), n_words, n_runs, runs (start, length, period by start, then period) and collapsed.

    A run is a stretch of words with a smallest period q, at least ``min_length`` and 2 * q words long, that
    no neighbouring word extends.  ``collapsed`` joins by one space the words no run holds after its first q words.
    Null, empty and blank texts have no words and no runs.  Each row is judged by itself, so repeated
    rows and equal ids make no difference; an empty table gives no rows; columns of ``docs`` that are
    not in ``keep`` are not read, and results replace none of them, as a name that clashes is refused.
    A text's words must fit into one task's memory, some 200 bytes a word.
    """
    keep = ["doc_id"] if keep is None else keep
    clash = {"n_words", "n_runs", "runs", "collapsed", "__text"} & set(keep)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} before: results have these names")
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(lambda batches: _runs(batches, keep, min_length), f"{kept}, {_FOUND}" if kept else _FOUND)


def planted_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, text): where the id's crc32 is divisible by ten the words get a periodic tail and are joined by one space.

    With g = crc32 / 10 and n words, the tail starts at word g % n and repeats its first
    1 + (n - start) / (3 + g % 8) words.  Texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(ident).cast("string").cast("binary"))
    rows = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text"),
                       F.when(h % 10 == 0, F.floor(h / 10).cast("long")).alias("__g"))
    rows = rows.withColumn("__words", F.when(F.col("__g").isNotNull(), F.array_remove(
        F.split(F.coalesce("__text", F.lit("")), _GAPS, -1), "")))  # only the few rows that change are split
    n, g = F.size("__words"), F.col("__g")
    rows = rows.withColumn("__start", F.when(n > 0, (g % n).cast("int")))
    rest = n - F.col("__start")
    rows = rows.withColumn("__period", (1 + F.floor(rest / (3 + g % 8))).cast("int"))
    period = F.slice("__words", F.col("__start") + 1, F.col("__period"))
    cycles = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("__period")).cast("int")))
    whole = F.concat(F.slice("__words", F.lit(1), F.col("__start")), F.slice(cycles, F.lit(1), rest))
    return rows.select(F.col("__id").alias(ident), F.when(F.col("__start").isNotNull(), F.array_join(whole, " "))
                       .otherwise(F.col("__text")).alias(text))


def run_digest(runs: Column) -> Column:
    """SHA-256 of every run's ``start,length,period`` and a line feed."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of several the first by start, then period; null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
