"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def groups_of(weights: np.ndarray, limit: int):
    """Consecutive (start, end) ranges whose weights sum to at most ``limit``; one element may exceed it alone."""
    total = np.concatenate([[0], np.cumsum(weights)])
    start = 0
    while start < len(weights):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield start, end
        start = end


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    _, offsets = utf8(batch.column(column))
    for start, end in groups_of(np.diff(offsets), limit):
        yield batch.slice(start, end - start)
