"""Repeated word windows found by fixed-block anchors.

Non-overlapping blocks of a little over half a window are the index: any repeated window holds one
whole block of its document.  Every rolling window of a block's length probes the index.  Hits are
extended: the full windows around them are compared by a long hash, and those that stand in two places
join to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.llm import tokens
from trendmill.llm.common import chunks, utf8
from trendmill.llm.exchange import bucket_count, covered, free_shuffles, join_runs, keyed, repeated_units
from trendmill.session import materialise


def _probes(piece: pa.RecordBatch, block: int):
    data, offsets = utf8(piece.column("__text"))
    starts, ends, first = tokens.words(data, offsets)
    index, hashes = tokens.window_hashes(tokens.word_hashes(data, starts, ends), first, block, seed=1)
    owner = np.searchsorted(first, index, "right") - 1
    return (index, (hashes >> np.uint64(32)).astype(np.uint32), hashes & np.uint64(0xFFFFFFFF),
            (index - first[owner]) % block == 0, first[:-1])


def _windows(piece: pa.RecordBatch, block: int, width: int):
    """The windows that hold a hit, by a 64-bit hash and another one for the bucket."""
    data, offsets = utf8(piece.column("__text"))
    starts, ends, first = tokens.words(data, offsets)
    hashes = tokens.word_hashes(data, starts, ends)
    wanted = np.zeros(len(starts), bool)
    for i, runs in enumerate(piece.column("__runs")):
        begin, end = first[i], first[i + 1]
        wanted[begin:end] = covered(np.frombuffer(runs.as_buffer(), np.int64), width - block, 0, end - begin)
    index, low = tokens.window_hashes(hashes, first, width, seed=2)
    _, high = tokens.window_hashes(hashes, first, width, seed=3)
    wanted = wanted[index]
    return index[wanted], low[wanted], high[wanted], np.ones(int(wanted.sum()), bool), first[:-1]


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, "__text"):
            totals, removed, kept = [], [], []
            for text, runs in zip(piece.column("__text").to_pylist(), piece.column("__runs").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = covered(np.frombuffer(runs or b"", np.int64), 0, width - 1, len(words))
                totals.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            others = [c for c in piece.schema.names if c not in ("__text", "__runs")]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in others), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [*others, "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = 35, text: str = "text", ident: str = "doc_id",
                   keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with n_words, n_removed and kept (the words that stay, one blank between).

    A word goes if a window of ``width`` words covers it whose words also start anywhere else, in the
    same or another row.  Windows are judged on the input.  Null texts have no words; rows equal in id
    and text count as two places and are cut alike; an empty table gives no rows.  Input columns with
    the names of the output are replaced.  Equality is that of hashes of more than 64 bits.
    """
    spark, block = docs.sparkSession, (width + 1) // 2
    out = ["n_words", "n_removed", "kept"]
    keep = [c for c in keep or docs.columns if c not in out]
    rows, buckets = keyed(docs, text, ident), bucket_count(docs, text)
    hits = materialise(repeated_units(rows, partial(_probes, block=block), "u4", buckets), "anchors")
    free_shuffles(spark)
    candidates = join_runs(rows, hits, "inner")
    runs = materialise(repeated_units(candidates, partial(_windows, block=block, width=width), "u8", buckets), "repeats")
    free_shuffles(spark)
    carried = docs.select(*keep, F.col(ident).alias("__id"), F.xxhash64(text).alias("__content"),
                          F.col(text).alias("__text"))
    found = join_runs(carried, runs, "left").drop("__id", "__content")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return found.mapInArrow(partial(_cut, width=width), f"{types}, n_words long, n_removed long, kept string")
