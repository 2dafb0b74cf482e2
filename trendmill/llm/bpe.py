"""Byte-level BPE of whole texts by tree concatenation, and back.

A long text is halved until its pieces are short; the pieces are encoded by themselves and joined
pairwise.  At a join a window of tokens around it is encoded again and grows until both sides agree
with it.  Pieces of texts beyond ``BLOCK_BYTES`` are rows that Spark spreads over its tasks.

Why a join is exact.  (1) The split pattern never lets a piece of text cross certain places, such
as one between a letter and a space after it, whatever stands around: both sides may be encoded
apart there.  (2) Inside one unsplit stretch a sequence of tokens is the encoding if every two neighbours
are the encoding of their own text: a first merge across a boundary would be made in the pair alone, too.
So where the window's outer token is that of a side, the side's neighbours beyond it stay right.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.llm.common import chunks, groups_of, shuffle_partitions

#: Bytes of a text encoded in one piece, and bytes of a text that stay in one task.
LEAF_BYTES, BLOCK_BYTES = 4096, 64 << 10
#: Bytes and ids handed to the library at once; it needs some 200 bytes for each token.
_TEXT_BYTES, _IDS = 256 << 10, 64 << 10
_KNOWN = 1 << 18  # stretches whose ids a task remembers, some 50 MB
_WINDOW = 4
_INSIDE = 32  # bytes of a window that may be taken for the inside of one stretch
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: White space beyond ASCII.
_WIDE_SPACES = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SIGN)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[28:32] = out[128:] = _OTHER  # not known from the byte alone
    return out


_CLASS = _byte_classes()
#: Last bytes of signs that are no white space: ASCII, and first bytes of Latin letters of two bytes.
_KNOWN_SIGN = np.isin(_CLASS, (_LETTER, _DIGIT, _SIGN))
_LATIN = np.isin(np.arange(256), (195, 196, 197))


def _byte_signs() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer file's content, read by the driver; the byte-level vocabulary of 50 257 ids by default.

    Only byte-level BPE with the usual split pattern, no normaliser and no space put in front is accepted.
    """
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        text = file.read()
    parts = json.loads(text)
    split, model = parts["pre_tokenizer"] or {}, parts["model"]
    if (split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
            or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or parts["normalizer"]):
        raise ValueError(f"{path} is no plain byte-level BPE")
    return text


class Coder:
    """A tokenizer with the byte width of each id."""

    def __init__(self, text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        signs = _byte_signs()
        self.bytes = {ident: bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
                      for token, ident in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.width = np.zeros(max(self.bytes) + 1, np.int64)
        for ident, own in self.bytes.items():
            self.width[ident] = len(own)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a stretch that occurs again, as most words do, is encoded once."""
        cut = [stretches(p) for p in pieces]
        flat = [s for own in cut for s in own]
        if len(self.known) > _KNOWN:
            self.forget()
        self.learn({s for s in flat if s not in self.known})
        row = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        size = self.first[row + 1] - self.first[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[row] - ends[:-1], size) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum([len(own) for own in cut])[:-1]])

    def forget(self) -> None:
        """``known`` numbers stretches; the ids of number n are ids[first[n]:first[n + 1]]."""
        self.known: dict[bytes, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, new: set[bytes]) -> None:
        # Stretches between two sure places may follow each other in one text: many small calls take longer.
        inner = [s for s in new if s[:1] == b" " and sure_end(s)]
        ids = self.tokenizer.encode(b"".join(inner).decode(), add_special_tokens=False).ids
        ends = np.cumsum(self.width[ids]) if ids else np.zeros(0, np.int64)
        bounds = np.searchsorted(ends, np.cumsum([len(s) for s in inner])) + 1 if inner else np.zeros(0, np.int64)
        rest = list(new.difference(inner))
        found = [e.ids for e in self.tokenizer.encode_batch([s.decode() for s in rest], add_special_tokens=False)]
        bounds = np.concatenate([bounds, len(ids) + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.known.update(zip([*inner, *rest], range(len(self.known), len(self.known) + len(new))))
        self.first = np.concatenate([self.first, self.first[-1] + bounds])
        self.ids = np.concatenate([self.ids, np.array([*ids, *chain.from_iterable(found)], np.int32)])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode(errors="replace")

    def window(self, piece: bytes) -> tuple[np.ndarray, bool]:
        """Ids, and whether the split pattern leaves the piece whole."""
        found = self.tokenizer.encode(piece.decode(), add_special_tokens=False)
        words = set(found.word_ids)
        return np.array(found.ids, np.int32), len(words) == 1 and None not in words


@lru_cache(maxsize=2)
def _coder(text: str) -> Coder:
    return Coder(text)


def certain(data: bytes, at: int) -> bool:
    """Whether the split pattern always ends a stretch before ``data[at]``, whatever stands around."""
    before, after = _CLASS[data[at - 1]], _CLASS[data[at]]
    if after == _SPACE and before == _OTHER:
        if data[at - 1] < 128:
            return False
        start = at - 1
        while data[start] & 0xC0 == 0x80:
            start -= 1
        return ord(data[start:at].decode()) not in _WIDE_SPACES
    if before in (_SPACE, _OTHER) or after == _OTHER or before == after:
        return False
    return not (data[at - 1] == 39 and after == _LETTER)  # 's and the like


def sure_end(data: bytes) -> bool:
    return bool(_KNOWN_SIGN[data[-1]]) or (data[-1] >= 128 and len(data) > 1 and bool(_LATIN[data[-2]]))


def stretches(data: bytes) -> list[bytes]:
    """The parts between places before a space that are ``certain``: words with the space before them, as a rule."""
    sign = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(sign[1:] == 32) + 1
    before = sign[at - 1]
    sure = _KNOWN_SIGN[before] | ((before >= 128) & _LATIN[sign[np.maximum(at - 2, 0)]])
    bounds = [0, *at[sure].tolist(), len(data)]
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def halving(data: bytes, low: int, high: int, limit: int, added: list[bytes]) -> list[int]:
    """Places that halve data[low:high] until no part is longer than ``limit`` bytes; ascending, without the ends.

    No place is inside a sign or an added token.
    """
    if high - low <= limit:
        return []
    middle = (low + high) // 2
    while middle > low and data[middle] & 0xC0 == 0x80:
        middle -= 1
    for token in added:
        near = data.find(token, max(low, middle - len(token) + 1), middle + len(token) - 1)
        if 0 <= near < middle < near + len(token):
            middle = near
    if middle == low:
        return []
    return [*halving(data, low, middle, limit, added), middle, *halving(data, middle, high, limit, added)]


def _reach(data: bytes, cut: int, widths: np.ndarray, tokens: int, sign: int) -> tuple[int, int]:
    """(tokens, place) at least ``tokens`` tokens away from the cut, at the start of a sign."""
    place = cut + sign * int(widths[:tokens].sum())
    while tokens < len(widths) and data[place] & 0xC0 == 0x80:
        place += sign * int(widths[tokens])
        tokens += 1
    return tokens, place


def concatenate(coder: Coder, data: bytes, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of data[low:high] from those of data[low:cut] and data[cut:high]."""
    if certain(data, cut):
        return np.concatenate([left, right])
    tokens = _WINDOW
    while True:
        before = coder.width[left[:-2 * tokens - 8:-1]]  # a sign has four tokens at most
        after = coder.width[right[:2 * tokens + 7]]
        n_left, start = _reach(data, cut, before, min(tokens, len(before)), -1)
        n_right, end = _reach(data, cut, after, min(tokens, len(after)), 1)
        window, whole = coder.window(data[start:end])
        ends = start + np.cumsum(coder.width[window])
        whole &= end - start >= _INSIDE
        first = last = None
        if start == low or (whole and window[0] == left[-n_left] and 39 not in data[max(low, start - 2):start]):
            first = (len(left) - n_left, 0)
        else:  # the place nearest to the cut where side and window end a token for certain
            own = cut - np.cumsum(before[:n_left])
            for place in own[np.isin(own, ends) & (own > start)]:
                if certain(data, int(place)):
                    first = (len(left) - 1 - int(np.flatnonzero(own == place)[0]), int(np.flatnonzero(ends == place)[0]) + 1)
                    break
        if end == high or (whole and window[-1] == right[n_right - 1]):
            last = (n_right, len(window))
        else:
            own = cut + np.cumsum(after[:n_right])
            for place in own[np.isin(own, ends) & (own < end)]:
                if certain(data, int(place)):
                    last = (int(np.flatnonzero(own == place)[0]) + 1, int(np.flatnonzero(ends == place)[0]) + 1)
                    break
        if first and last:
            return np.concatenate([left[:first[0]], window[first[1]:last[1]], right[last[0]:]])
        tokens *= 2


def join_tree(coder: Coder, data: bytes, bounds: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the text whose pieces between ``bounds`` have the ids ``parts``: neighbours are joined level by level."""
    while len(parts) > 1:
        joined = [concatenate(coder, data, bounds[i], bounds[i + 1], bounds[i + 2], parts[i], parts[i + 1])
                  for i in range(0, len(parts) - 1, 2)]
        if len(parts) % 2:
            joined.append(parts[-1])
        bounds, parts = [*bounds[:-1:2], bounds[-1]], joined
    return parts[0]


def encode_texts(coder: Coder, texts: list[bytes], leaf: int = LEAF_BYTES) -> list[np.ndarray]:
    """Ids of each text; all leaves of all texts are encoded together, then joined per text."""
    bounds = [[0, *halving(t, 0, len(t), leaf, coder.added), len(t)] for t in texts]
    leaves = iter(coder.encode([t[a:b] for t, own in zip(texts, bounds) for a, b in zip(own, own[1:])]))
    return [join_tree(coder, t, own, [next(leaves) for _ in own[1:]]) for t, own in zip(texts, bounds)]


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def _encode_rows(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        for piece in chunks(batch, "__text", _TEXT_BYTES):
            ids = encode_texts(coder, [(t or "").encode() for t in piece.column("__text").to_pylist()])
            rest = [c for c in piece.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), _id_lists(ids)], [*rest, "ids"])


def _cut_rows(batches: Iterator[pa.RecordBatch], vocabulary, block: int) -> Iterator[pa.RecordBatch]:
    added = _coder(vocabulary.value).added
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column("__text")[row].as_py().encode()
            bounds = [0, *halving(data, 0, len(data), block, added), len(data)]
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(batch.column(c)[row], n) for c in ("__id", "__content", "__copies")), pa.array(bounds[:-1], pa.int64()),
                 pa.array([data[a:b].decode() for a, b in zip(bounds, bounds[1:])])],
                ["__id", "__content", "__copies", "__at", "__text"])


def _join_blocks(blocks: pa.Table, vocabulary) -> pa.Table:
    coder = _coder(vocabulary.value)
    blocks = blocks.sort_by("__at")
    texts = [t.encode() for t in blocks.column("__block").to_pylist()]
    data = b"".join(texts)
    parts = [np.array(x, np.int32) for x in blocks.column("ids").to_pylist()]
    bounds = [*blocks.column("__at").to_pylist(), len(data)]
    ids = join_tree(coder, data, bounds, parts)
    copies = blocks.column("__copies")[0].as_py()
    return pa.table([pa.repeat(blocks.column("__id")[0], copies), _id_lists([ids] * copies)], ["__id", "ids"])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ident: str = "doc_id",
           block: int = BLOCK_BYTES) -> DataFrame:
    """(ident, ids): the token ids of every row's text, special tokens written in the text included, none added.

    Null and empty texts have no ids.  Repeated rows and equal ids give a row each; the order of
    rows is not kept; an empty table gives no rows; other columns are not read.  A text beyond ``block``
    bytes is encoded by several tasks and joined in one, which holds that text and its ids, as a row does anyway.
    ``path`` is read by the driver only.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_text(path))  # some 2 MB, whatever the corpus
    rows = docs.select(F.col(ident).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    long = F.octet_length("__text") > block
    encoder = partial(_encode_rows, vocabulary=vocabulary)
    short = rows.where(~long).mapInArrow(encoder, f"__id {kind}, ids array<int>")
    # Rows equal in id and text are one until the end, so that blocks of one text never mix with another's.
    once = rows.where(long).groupBy("__id", "__text").agg(F.count("*").alias("__copies"))
    once = once.withColumn("__content", F.sha2("__text", 256)).select("__id", "__content", "__copies", "__text")
    key = f"__id {kind}, __content string, __copies long, __at long"
    blocks = once.mapInArrow(partial(_cut_rows, vocabulary=vocabulary, block=block), f"{key}, __text string")
    blocks = blocks.withColumn("__block", F.col("__text")).repartition(shuffle_partitions(spark), "__content", "__at")
    coded = blocks.mapInArrow(encoder, f"{key}, __block string, ids array<int>")
    joined = coded.groupBy("__id", "__content").applyInArrow(
        lambda group: _join_blocks(group, vocabulary), f"__id {kind}, ids array<int>")
    return short.unionByName(joined).select(F.col("__id").alias(ident), "ids")


def _decode_rows(batches: Iterator[pa.RecordBatch], vocabulary, ids: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False)
        for start, end in groups_of(sizes, _IDS):
            piece = batch.slice(start, end - start)
            texts = pa.array([coder.decode(flat[a:b]) for a, b in zip(ends[start:end], ends[start + 1:end + 1])], pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns, texts], [*piece.schema.names, "decoded"])


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids, special tokens included; null and empty lists give the empty text.

    A column ``decoded`` of ``rows`` is replaced.  Bytes that are no UTF-8 become replacement signs.
    """
    vocabulary = rows.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    rows = rows.drop("decoded")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_decode_rows, vocabulary=vocabulary, ids=ids), f"{kept}, decoded string")
