"""Equal hashes across a corpus, exchanged in packed rows.

Every unit (a word window, a byte anchor ...) of every document has a hash.  A task
packs the hashes of a chunk of documents into one binary row per bucket, each distinct
hash once, so a hot hash costs one entry per chunk.  The bucket's task sees all chunks'
entries, and what is found in two places goes back to its chunk as positions.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.llm.common import chunks, shuffle_partitions

#: Text a task packs at once, and text per bucket.  More of the first makes longer rows on huge inputs.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 48 << 20
_ANCHOR, _MANY, _INDEX = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)
_DOCUMENTS, _ENTRIES, _HITS = 0, 1, 2


def keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(__id, __content, __text): documents equal in id and text are one to the exchange."""
    return docs.select(F.col(ident).alias("__id"), F.xxhash64(text).alias("__content"), F.col(text).alias("__text"))


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets that grow with the text, and no fewer than shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES + 1)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that are gone; they count as disk until then.

    The first round frees the driver's handles, the second what only they referred to.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def to_runs(positions: np.ndarray) -> np.ndarray:
    """(start, length) pairs of consecutive positions, flat; positions ascend."""
    if not len(positions):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.diff(positions, prepend=positions[0] - 2) != 1)
    lengths = np.diff(np.append(heads, len(positions)))
    return np.stack([positions[heads], lengths], 1).astype(np.int64).ravel()


def covered(runs: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Mask of ``size`` places: each run of flat (start, length) pairs, ``before`` and ``after`` more."""
    change = np.zeros(size + 1, np.int32)
    pairs = runs.reshape(-1, 2)
    np.add.at(change, np.clip(pairs[:, 0] - before, 0, size), 1)
    np.add.at(change, np.clip(pairs[:, 0] + pairs[:, 1] + after, 0, size), -1)
    return np.cumsum(change[:-1]) > 0


def _schema(id_type: str, *first: str) -> str:
    return ", ".join([*first, "tag long", "kind int", "blob binary", f"ids array<{id_type}>", "contents array<long>",
                      "firsts array<long>"])


def binary_column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of a byte array cut at ``ends`` (first 0), counted in elements."""
    offsets = (ends * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _pack(batches: Iterator[pa.RecordBatch], units: Callable, buckets: int, seed: bytes) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in chunks(batch, "__text", CHUNK_BYTES):
            ids, contents = piece.column("__id"), piece.column("__content")
            number += 1
            digest = xxhash.xxh3_64(seed + f"{part} {number}".encode())
            digest.update(np.array(contents.to_pylist(), np.int64).tobytes())
            tag = digest.intdigest() - (1 << 63)
            index, low, high, anchor, firsts = units(piece)
            none = lambda t: pa.nulls(1, t)
            id_list, long_list = pa.list_(ids.type), pa.list_(pa.int64())
            names = ["bucket", "tag", "kind", "blob", "ids", "contents", "firsts"]

            def row(kind, blob, *lists):
                lists = lists or (None, None, None)
                return pa.RecordBatch.from_arrays(
                    [pa.array([-1 - (tag % buckets)], pa.int32()), pa.array([tag], pa.int64()), pa.array([kind], pa.int32()),
                     pa.array([blob], pa.binary()),
                     *(none(t) if x is None else pa.array([x], t) for x, t in zip(lists, (id_list, long_list, long_list)))],
                    names)

            yield row(_DOCUMENTS, None, ids.to_pylist(), contents.to_pylist(), firsts.tolist())
            if not len(index):
                continue
            bucket = (high % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((low, bucket))
            bucket, low, index, anchor = bucket[order], low[order], index[order].astype(np.uint32), anchor[order]
            heads = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])))
            count = np.diff(np.append(heads, len(low)))
            many = count > 1
            if many.any():  # found twice in this chunk: known here without asking
                yield row(_HITS, np.sort(index[np.repeat(many, count)]).tobytes())
            entries = np.empty(len(heads), [("hash", low.dtype), ("index", np.uint32)])
            entries["hash"] = low[heads]
            flags = np.where(np.logical_or.reduceat(anchor, heads), _ANCHOR, np.uint32(0))
            entries["index"] = (index[heads] & _INDEX) | flags | np.where(many, _MANY, np.uint32(0))
            own, starts = np.unique(bucket[heads], return_index=True)
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(np.full(n, tag, np.int64)), pa.array(np.full(n, _ENTRIES, np.int32)),
                 binary_column(entries, np.append(starts, len(entries))), pa.nulls(n, id_list), pa.nulls(n, long_list),
                 pa.nulls(n, long_list)], names)


def _match(table: pa.Table, dtype: np.dtype) -> pa.Table:
    """One bucket: positions whose hash stands in two places, one of them an anchor."""
    kinds = table.column("kind").to_numpy()
    table = table.drop_columns(["bucket"])
    if not (kinds == _ENTRIES).any():
        return table
    rest = table.filter(pa.array(kinds != _ENTRIES))
    asked = table.filter(pa.array(kinds == _ENTRIES))
    blobs = [np.frombuffer(x.as_buffer(), dtype) for x in asked.column("blob")]
    row = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
    entries = np.concatenate(blobs)
    order = np.argsort(entries["hash"], kind="stable")
    hashes, index, row = entries["hash"][order], entries["index"][order], row[order]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    many = (index & _MANY) > 0
    size = np.diff(np.append(heads, len(hashes)))
    hit = (np.add.reduceat(1 + many.astype(np.int64), heads) > 1) & np.logical_or.reduceat((index & _ANCHOR) > 0, heads)
    hit = np.repeat(hit, size) & ~many
    index, row = index[hit] & _INDEX, row[hit]
    back = np.argsort(row, kind="stable")
    own, starts = np.unique(row[back], return_index=True)
    n = len(own)
    if not n:
        return rest
    out = pa.table([asked.column("tag").take(pa.array(own)), pa.array(np.full(n, _HITS, np.int32)),
                    binary_column(index[back], np.append(starts, len(index))),
                    *(pa.nulls(n, rest.schema.field(c).type) for c in ("ids", "contents", "firsts"))],
                   schema=rest.schema)
    return pa.concat_tables([rest, out])


def _gather(table: pa.Table) -> pa.Table:
    """One chunk: runs of hit positions per document, counted from the document's start."""
    kinds = table.column("kind").to_numpy()
    documents = table.filter(pa.array(kinds == _DOCUMENTS)).slice(0, 1)
    blobs = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.filter(pa.array(kinds == _HITS)).column("blob")]
    ids = documents.column("ids").combine_chunks().flatten()
    contents = documents.column("contents").combine_chunks().flatten()
    firsts = documents.column("firsts").combine_chunks().flatten().to_numpy()
    index = np.unique(np.concatenate(blobs)).astype(np.int64) if blobs else np.zeros(0, np.int64)
    owner = np.searchsorted(firsts, index, "right") - 1
    own, starts = np.unique(owner, return_index=True)
    ends = np.append(starts, len(index))
    runs = [to_runs(index[a:b] - firsts[o]).tobytes() for o, a, b in zip(own, ends, ends[1:])]
    return pa.table([ids.take(pa.array(own)), contents.take(pa.array(own)), pa.array(runs, pa.binary())],
                    ["__id", "__content", "__runs"])


def repeated_units(rows: DataFrame, units: Callable, hash_type: str, buckets: int) -> DataFrame:
    """(__id, __content, __runs) of documents with units that stand in two places.

    ``rows`` has __id, __content and __text.  ``units(batch)`` gives for a chunk of rows: position,
    hash, a second hash that picks the bucket, whether the unit is an anchor, and each row's first
    position.  __runs is a binary of int64 (start, length) pairs of hit positions in the document.
    """
    id_type = rows.schema["__id"].dataType.simpleString()
    dtype = np.dtype([("hash", hash_type), ("index", np.uint32)])
    packed = rows.mapInArrow(partial(_pack, units=units, buckets=buckets, seed=hash_type.encode()),
                             _schema(id_type, "bucket int"))
    matched = packed.groupBy("bucket").applyInArrow(lambda table: _match(table, dtype), _schema(id_type))
    return (matched.groupBy("tag").applyInArrow(_gather, f"__id {id_type}, __content long, __runs binary")
            .dropDuplicates(["__id", "__content"]))


def join_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """``rows`` with their __runs."""
    runs = runs.select(F.col("__id").alias("__own"), F.col("__content").alias("__same"), "__runs")
    return (rows.join(runs, rows["__id"].eqNullSafe(F.col("__own")) & (rows["__content"] == F.col("__same")), how)
            .drop("__own", "__same"))
