"""Repeated byte strings by suffix sorting in two stages.

Suffixes that can be equal over the wanted length are brought together first: each window of that
length is represented by the least hash among its short strings (the same one wherever the window
stands), and only windows whose representative occurs twice go on, to the task of that hash.  There the
suffixes smaller than their successors are sorted directly, the rest is induced from them by scanning
the buckets of first bytes, and adjacent suffixes with a long common prefix are repeats.  The windows of
a representative that very many places share don't go to one task: they meet by 128 bits of their own hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.llm import tokens
from trendmill.llm.common import chunks, utf8
from trendmill.llm.exchange import (
    binary_column,
    bucket_count,
    covered,
    free_shuffles,
    join_runs,
    keyed,
    repeated_units,
)
from trendmill.session import materialise

_PLACE = np.uint64((1 << 28) - 1)
_PIECE = 1 << 20
_LAST = (1 << 63) - 1
#: Snippets of one representative that a task sorts; the windows of those with more are spread by their own hash.
HOT_SNIPPETS = 1 << 14


def representatives(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Pieces of: starts of all windows of ``width`` bytes inside one text, their representatives' places and hashes.

    The representative is the leftmost of the least hashes among the window's strings of ``gram`` bytes.
    """
    table, base = tokens.symbols(5), tokens.factor(5)
    scale = tokens.powers(base, min(len(data), _PIECE + width) + 1)
    inverse = tokens.powers(np.uint64(pow(int(base), -1, 1 << 64)), len(scale))
    span = width - gram + 1
    ends = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets)) if len(data) < 1 << 31 else np.repeat(
        offsets[1:], np.diff(offsets))
    for begin in range(0, max(0, len(data) - width + 1), _PIECE):
        end = min(begin + _PIECE, len(data) - width + 1)
        piece = data[begin:end + width - 1]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(table[piece] * scale[:len(piece)])])
        value = tokens.mix((prefix[gram:] - prefix[:-gram]) * inverse[:len(piece) - gram + 1])
        least = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:end - begin], least[span - reach:span - reach + end - begin])
        inside = np.flatnonzero(np.arange(begin, end) + width <= ends[begin:end])
        place = (least[inside] & _PLACE).astype(np.int64)
        yield inside + begin, place + begin, value[place]


def _anchors(piece: pa.RecordBatch, width: int, gram: int):
    data, offsets = utf8(piece.column("__text"))
    found, last = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], -1
    for _, places, hashes in representatives(data, offsets, width, gram):
        new = np.flatnonzero(np.diff(places, prepend=last) != 0)  # places ascend with the windows
        last = places[-1] if len(places) else last
        found.append((places[new], hashes[new]))
    places, hashes = map(np.concatenate, zip(*found))
    return (places, (hashes >> np.uint64(32)).astype(np.uint32), hashes & np.uint64(0xFFFFFFFF),
            np.ones(len(places), bool), offsets[:-1])


_META = np.dtype([("hash", "<u8"), ("id", "<i8"), ("content", "<i8"), ("start", "<i8"), ("count", "<i8")])
_WINDOW = np.dtype([("hash", "<u8"), ("more", "<u8"), ("id", "<i8"), ("content", "<i8"), ("start", "<i8")])


def _same_place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether both are the same place of one document, as in rows equal in id and text."""
    return (left["id"] == right["id"]) & (left["content"] == right["content"]) & (left["start"] == right["start"])


def _repeated_windows(batches: Iterator[pa.RecordBatch], width: int, gram: int):
    """Per chunk: the rows, their bytes and offsets; starts, representatives' places and hashes of windows in __runs."""
    for batch in batches:
        for piece in chunks(batch, "__text", 2 << 20):
            data, offsets = utf8(piece.column("__text"))
            wanted = np.zeros(len(data) + 1, bool)
            for i, runs in enumerate(piece.column("__runs")):
                begin, end = offsets[i], offsets[i + 1]
                wanted[begin:end] = covered(np.frombuffer(runs.as_buffer(), np.int64), 0, 0, end - begin)
            found = [tuple(x[wanted[part[1]]] for x in part) for part in representatives(data, offsets, width, gram)]
            if found:
                starts, places, hashes = map(np.concatenate, zip(*found))
                if len(starts):
                    yield piece, data, offsets, starts, places, hashes


def _snippet_heads(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (np.diff(places) != 0) | (np.diff(starts) != 1)))


def _snippet_counts(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(hash, snippets) of each chunk."""
    for _, _, _, starts, places, hashes in _repeated_windows(batches, width, gram):
        own, counts = np.unique(hashes[_snippet_heads(starts, places)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts.astype(np.int64))],
                                         ["hash", "snippets"])


def _window_hashes(data: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of the windows at ascending ``starts``."""
    table, base = tokens.symbols(seed), tokens.factor(seed)
    scale = tokens.powers(base, min(len(data), _PIECE + width) + 1)
    inverse = tokens.powers(np.uint64(pow(int(base), -1, 1 << 64)), len(scale))
    out = np.empty(len(starts), np.uint64)
    for begin in range(0, len(data), _PIECE):
        a, b = np.searchsorted(starts, [begin, begin + _PIECE])
        if a < b:
            piece, at = data[begin:begin + _PIECE + width - 1], starts[a:b] - begin
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(table[piece] * scale[:len(piece)])])
            out[a:b] = tokens.mix((prefix[at + width] - prefix[at]) * inverse[at])
    return out


def _later(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash and place; in it, which windows are their hash's first and which repeat an earlier place."""
    order = np.lexsort(tuple(windows[c] for c in ("start", "content", "id", "more", "hash")))
    own = windows[order]
    first = np.append(True, (own["hash"][1:] != own["hash"][:-1]) | (own["more"][1:] != own["more"][:-1]))
    head = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    return order, first, ~first & ~_same_place(own, head)


def _spread(windows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of hot representatives, in the order of a chunk, to buckets from ``buckets`` on by their own 128-bit hash.

    A window that a chunk has twice is sent once, as its first; the others are repeated.
    """
    for at in range(0, len(windows), 1 << 22):
        part = windows[at:at + (1 << 22)]
        order, first, later = _later(part)
        sent, twice = part[order[first]], part[np.sort(order[later])]
        bucket = buckets + (sent["hash"] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        own, cuts = np.unique(bucket[by], return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), binary_column(sent[by], np.append(cuts, len(by))),
             pa.array([b""] * len(own), pa.binary())], ["bucket", "meta", "bytes"])
        if len(twice):
            heads = np.flatnonzero(np.append(True, (np.diff(twice["start"]) != 1) | (np.diff(twice["id"]) != 0)
                                             | (np.diff(twice["content"]) != 0)))
            meta = np.empty(len(heads), _META)
            for c in ("hash", "id", "content", "start"):
                meta[c] = twice[c][heads]
            meta["count"] = np.diff(np.append(heads, len(twice)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - int(meta["hash"][0] % np.uint64(buckets))], pa.int32()), pa.array([meta.tobytes()], pa.binary()),
                 pa.array([b""], pa.binary())], ["bucket", "meta", "bytes"])


def _snippets(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int,
              hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, meta, bytes): for each run of windows with one repeated representative, the bytes they cover.

    A snippet that a chunk has twice is sent once, as its first; the others are wholly repeated and go
    to negative buckets without bytes.  Windows whose representative is ``hot`` go one by one, by hash.
    """
    for piece, data, offsets, starts, places, hashes in _repeated_windows(batches, width, gram):
        ids = np.array([_LAST if x is None else x for x in piece.column("__id").to_pylist()], np.int64)
        contents = np.array(piece.column("__content").to_pylist(), np.int64)
        many = np.isin(hashes, hot)
        if many.any():
            at = starts[many]
            owner = np.searchsorted(offsets, at, "right") - 1
            windows = np.empty(len(at), _WINDOW)
            windows["hash"], windows["more"] = (_window_hashes(data, at, width, seed) for seed in (6, 7))
            windows["id"], windows["content"], windows["start"] = ids[owner], contents[owner], at - offsets[owner]
            yield from _spread(windows, buckets)
            starts, places, hashes = starts[~many], places[~many], hashes[~many]
            if not len(starts):
                continue
        heads = _snippet_heads(starts, places)
        meta = np.empty(len(heads), _META)
        owner = np.searchsorted(offsets, starts[heads], "right") - 1
        meta["hash"], meta["id"] = hashes[heads], ids[owner]
        meta["content"] = contents[owner]
        meta["start"] = starts[heads] - offsets[owner]
        meta["count"] = np.diff(np.append(heads, len(starts)))
        order = np.lexsort((meta["start"], meta["content"], meta["id"]))
        whole, seen = data.tobytes(), {}
        places, meta, texts = starts[heads][order].tolist(), meta[order], []
        earlier = np.arange(len(order))
        for at, (begin, count) in enumerate(zip(places, meta["count"].tolist())):
            text = whole[begin:begin + count + width - 1]
            first = seen.setdefault(text, at)
            earlier[at] = first
            texts.append(text if first == at else b"")
        twice = earlier != np.arange(len(order))
        kept = np.flatnonzero(~(twice & _same_place(meta, meta[earlier])))  # an equal row repeats nothing
        meta, twice, texts = meta[kept], twice[kept], [texts[i] for i in kept.tolist()]
        bucket = (tokens.mix(meta["hash"]) % np.uint64(buckets)).astype(np.int64)
        bucket[twice] = -1 - bucket[twice]
        order = np.argsort(bucket, kind="stable")
        own, cuts = np.unique(bucket[order], return_index=True)
        cuts = np.append(cuts, len(order))
        joined = [b"".join(texts[i] for i in order[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), binary_column(meta[order], cuts), pa.array(joined, pa.binary())],
            ["bucket", "meta", "bytes"])


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor; equal bytes pass the answer on."""
    change = np.sign(np.diff(text.astype(np.int16), append=-1))
    at = np.arange(len(text))
    at[change == 0] = len(text)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return change[np.minimum(nearest, len(text) - 1)] > 0


def two_stage_order(text: bytes, places: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the suffixes at ascending ``places`` in the order of their first ``width`` bytes.

    Stage one sorts the suffixes smaller than their successors directly.  Stage two scans the buckets
    of first bytes upwards: each suffix that is reached puts its predecessor, if that is larger, behind
    those already in the predecessor's bucket.  A larger suffix whose successor isn't among the places
    can't be induced; these few are sorted directly and merged into their bucket.
    """
    data = np.frombuffer(text, np.uint8)
    index_of = np.full(len(data) + 1, -1, np.int64)
    index_of[places] = np.arange(len(places))
    rising = _rising(data)[places]
    induced = ~rising & (index_of[places + 1] >= 0)
    first = data[places]

    def key(i: int) -> bytes:
        at = places[i]
        return text[at:at + width]

    direct = np.array(sorted(np.flatnonzero(rising).tolist(), key=key), np.int64)
    cuts = np.searchsorted(first[direct], np.arange(257))
    alone: dict[tuple[int, int], list[int]] = {}  # by first byte and length of the run of it
    for i in sorted(np.flatnonzero(~rising & ~induced).tolist(), key=key):
        window = key(i)
        alone.setdefault((window[0], len(window) - len(window.lstrip(window[:1]))), []).append(i)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(found: np.ndarray) -> None:
        out.append(found)
        before = places[found] - 1
        before = index_of[before[before >= 0]]
        before = before[before >= 0]
        before = before[induced[before]]
        letters = first[before]
        for letter in np.unique(letters).tolist():
            waiting[letter].append(before[letters == letter])

    for letter in range(256):
        runs = sorted(n for byte, n in alone if byte == letter)
        run = 1
        while waiting[letter] or runs:  # suffixes that begin with a run of ``run`` such bytes
            found = np.concatenate(waiting[letter]) if waiting[letter] else np.zeros(0, np.int64)
            waiting[letter] = []
            if runs and (runs[0] == run or not len(found)):
                others = alone[letter, runs.pop(0)]
                ranks = [bisect_left(found, key(i), key=key) for i in others]
                found = np.insert(found, ranks, others)
            scan(found)
            run += 1
        scan(direct[cuts[letter]:cuts[letter + 1]])
    return np.concatenate(out)


def _same(data: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffixes have a common prefix of ``width`` bytes."""
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    out = np.empty(len(left), bool)
    for at in range(0, len(left), 1 << 16):
        out[at:at + (1 << 16)] = (views[left[at:at + (1 << 16)]] == views[right[at:at + (1 << 16)]]).all(1)
    return out


def _repeats(key: tuple, table: pa.Table, width: int, buckets: int) -> pa.Table:
    """One bucket: the windows that also start earlier, as runs."""
    if key[0].as_py() >= buckets:
        windows = np.concatenate([np.frombuffer(x.as_buffer(), _WINDOW) for x in table.column("meta")])
        order, _, later = _later(windows)
        windows = windows[order[later]]
        return _runs_table(windows["id"], windows["content"], windows["start"], np.ones(len(windows), np.int64))
    metas = [np.frombuffer(x.as_buffer(), _META) for x in table.column("meta")]
    if key[0].as_py() < 0:
        later = np.concatenate(metas)
        return _runs_table(later["id"], later["content"], later["start"], later["count"])
    meta = np.concatenate(metas)
    blobs = [x.as_py() for x in table.column("bytes")]
    texts = []
    for own, blob in zip(metas, blobs):
        ends = np.concatenate([[0], np.cumsum(own["count"] + width - 1)]).tolist()
        texts += [blob[a:b] for a, b in zip(ends, ends[1:])]
    del blobs
    order = np.lexsort((meta["start"], meta["content"], meta["id"]))
    earliest: dict[bytes, int] = {}
    again, first = [], []
    for at in order.tolist():  # equal snippets: all but the first are wholly repeated
        if earliest.setdefault(texts[at], at) != at:
            again.append(at)
            first.append(earliest[texts[at]])
    later = meta[again]
    later = later[~_same_place(later, meta[first])]
    found = [_runs_table(later["id"], later["content"], later["start"], later["count"])]
    own = np.array(sorted(earliest.values()), np.int64)
    hashes, sizes = np.unique(meta["hash"][own], return_counts=True)
    own = own[np.isin(meta["hash"][own], hashes[sizes > 1])]  # a lone snippet equals no other
    if len(own):
        found.append(_among(meta[own], [texts[i] for i in own.tolist()], width))
    return pa.concat_tables(found)


def _among(meta: np.ndarray, texts: list[bytes], width: int) -> pa.Table:
    text = b"".join(texts)
    data = np.frombuffer(text, np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    owner = np.repeat(np.arange(len(meta)), meta["count"])
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(meta["count"]) - meta["count"], meta["count"])
    places = begins[owner] + offset
    order = two_stage_order(text, places, width)
    same = _same(data, places[order[:-1]], places[order[1:]], width)
    group = np.concatenate([[0], np.cumsum(~same)])
    # The earliest of a group of equal windows stays; documents come by id, content and place.
    rank = np.empty(len(meta), np.int64)
    same_document = np.lexsort((meta["content"], meta["id"]))
    head = np.append(True, (np.diff(meta["id"][same_document]) != 0) | (np.diff(meta["content"][same_document]) != 0))
    rank[same_document] = np.cumsum(head)
    at = (meta["start"][owner] + offset)[order]
    by = np.lexsort((at, rank[owner[order]], group))
    repeated = np.zeros(len(owner), bool)
    repeated[order[by[~np.append(True, np.diff(group[by]) != 0)]]] = True
    if not repeated.any():
        return _runs_table(*(np.zeros(0, np.int64) for _ in range(4)))
    heads = np.flatnonzero(repeated & ~np.append(False, repeated[:-1] & (owner[1:] == owner[:-1])))
    marks = np.cumsum(np.isin(np.arange(len(owner)), heads))[repeated]
    count = np.bincount(marks)[1:]
    who = owner[heads]
    return _runs_table(meta["id"][who], meta["content"][who], meta["start"][who] + offset[heads], count)


def _runs_table(ids, contents, starts, counts) -> pa.Table:
    return pa.table([pa.array(np.asarray(x, np.int64)) for x in (ids, contents, starts, counts)],
                    ["id", "content", "start", "count"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, "__text"):
            sizes, removed, spans, kept = [], [], [], []
            for text, starts, counts in zip(*(piece.column(c).to_pylist() for c in ("__text", "__starts", "__counts"))):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                runs = np.array([starts or [], counts or []], np.int64).T.reshape(-1)
                gone = covered(runs, 0, width - 1, len(data))
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0)
                kept.append(data[~gone].tobytes())
            others = [c for c in piece.schema.names if c not in ("__text", "__starts", "__counts")]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in others), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                 pa.array(kept, pa.binary())], [*others, "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, width: int = 100, gram: int = 40, text: str = "text", ident: str = "doc_id",
                          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with n_bytes, n_removed, n_spans and kept (the bytes that stay).

    A byte goes if a string of ``width`` bytes covers it that also starts earlier: in a document of
    smaller integer id (null ids last; equal ids by hash of the text), or earlier in the same one.
    Strings are judged on the input.  Null text is empty; rows equal in id and text are one document
    and are cut alike; an empty table gives no rows.  ``kept`` is binary, since a cut may fall inside
    a character.  Input columns with names of the output are replaced.
    """
    spark = docs.sparkSession
    out = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in keep or docs.columns if c not in out]
    rows, buckets = keyed(docs, text, ident), bucket_count(docs, text)
    rows = rows.withColumn("__id", F.col("__id").cast("long"))
    hits = materialise(repeated_units(rows, partial(_anchors, width=width, gram=gram), "u4", buckets), "anchors")
    free_shuffles(spark)
    counts = join_runs(rows, hits, "inner").mapInArrow(
        partial(_snippet_counts, width=width, gram=gram), "hash long, snippets long")
    most = counts.groupBy("hash").agg(F.sum("snippets").alias("n")).where(F.col("n") > HOT_SNIPPETS)
    # At most one in HOT_SNIPPETS of all snippets.
    hot = np.array([r["hash"] for r in most.select("hash").collect()], np.int64).view(np.uint64)
    free_shuffles(spark)
    buckets *= 8
    pieces = join_runs(rows, hits, "inner").mapInArrow(
        partial(_snippets, width=width, gram=gram, buckets=buckets, hot=hot), "bucket int, meta binary, bytes binary")
    runs = materialise(pieces.groupBy("bucket").applyInArrow(
        lambda key, table: _repeats(key, table, width, buckets), "id long, content long, start long, count long"), "repeats")
    free_shuffles(spark)
    runs = (runs.distinct().groupBy(F.col("id").alias("__own"), F.col("content").alias("__same"))
            .agg(F.collect_list("start").alias("__starts"), F.collect_list("count").alias("__counts")))
    carried = docs.select(*keep, F.coalesce(F.col(ident).cast("long"), F.lit(_LAST)).alias("__id"),
                          F.xxhash64(text).alias("__content"), F.col(text).alias("__text"))
    found = carried.join(runs, (F.col("__id") == F.col("__own")) & (F.col("__content") == F.col("__same")), "left")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return (found.select(*keep, "__text", "__starts", "__counts")
            .mapInArrow(partial(_cut, width=width), f"{types}, n_bytes long, n_removed long, n_spans long, kept binary"))
