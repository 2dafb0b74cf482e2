"""Language identification by bit-sliced Bloom filters over byte n-grams.

One table of bit masks holds all languages' filters: the masks at an n-gram's places, and-ed, name
every language that has it.  Counts per language, less what its filter would say yes to by chance,
decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill.llm.common import chunks, utf8
from trendmill.llm.tokens import mix
from trendmill.session import materialise

#: log2 of the table's size and places per n-gram: 2^18 masks of 64 languages are 2 MB.
TABLE_BITS, PLACES, WIDTH = 18, 3, 5
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of WIDTH bytes inside one text, and each one's text index.

    ASCII letters are lower-cased and other ASCII signs are blanks; n-grams with two blanks in a
    row say nothing and are left out.
    """
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    folded = _FOLD[data]
    blank = folded == 32
    bad = np.zeros(n, bool)
    value = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        value = (value << np.uint64(8)) | folded[j:j + n]
        if j:
            bad |= blank[j:j + n] & blank[j - 1:j - 1 + n]
    for end in range(1, WIDTH):  # windows that reach into the next text
        cut = offsets[1:-1] - end
        bad[cut[(cut >= 0) & (cut < n)]] = True
    at = np.flatnonzero(~bad)
    return mix(value[at]), np.searchsorted(offsets, at, "right") - 1


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(PLACES):
        yield ((hashes >> np.uint64(TABLE_BITS * i)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's first row of every (lang, content); what it remembers is bounded by the sample."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keys, new = list(zip(batch.column("lang").to_pylist(), batch.column("content").to_pylist())), []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def _gram_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) of each task: how many of its documents have the n-gram; all of them for gram null."""
    seen: dict[str, Counter] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for piece in chunks(batch, "text"):
            hashes, owner = grams(*utf8(piece.column("text")))
            langs = piece.column("lang").to_pylist()
            sizes.update(langs)
            bounds = np.searchsorted(owner, np.arange(len(langs) + 1))
            for i, lang in enumerate(langs):
                seen.setdefault(lang, Counter()).update(np.unique(hashes[bounds[i]:bounds[i + 1]]).tolist())
    for lang, counts in seen.items():
        values = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(values) + 1), pa.string()), pa.array([*values.tolist(), None], pa.int64()),
             pa.array([*counts.values(), sizes[lang]], pa.int64())],
            ["lang", "gram", "documents"])


class LanguageModel:
    """Languages, the table of masks and each language's share of false hits."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.by_chance = np.array([[np.mean((table[w] >> np.uint64(b)) & np.uint64(1)) ** PLACES]
                                   for w, b in map(self._slot, range(len(langs)))]).reshape(-1)

    @staticmethod
    def _slot(i: int) -> tuple[int, int]:
        return divmod(i, 64)

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text and language: the share of its n-grams in the filter, freed of chance."""
        hashes, owner = grams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(owner, minlength=n)
        places = list(_places(hashes))
        out = np.zeros((n, len(self.langs)))
        for word in range(len(self.table)):
            masks = self.table[word][places[0]]
            for place in places[1:]:
                masks = masks & self.table[word][place]
            for i in range(64 * word, min(64 * word + 64, len(self.langs))):
                has = ((masks >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                out[:, i] = np.bincount(owner[has], minlength=n)
        shares = out / np.maximum(total, 1)[:, None]
        return np.clip((shares - self.by_chance) / np.maximum(1 - self.by_chance, 1e-9), 0, 1)


def learn(labelled: DataFrame, documents_per_language: int = 2000, least_share: float = 0.02,
          text: str = "text", lang: str = "lang") -> LanguageModel:
    """Filters of the n-grams that at least ``least_share`` of a language's documents have, twice or more.

    Copies of a text under one label are one document, here and in all counts.  ``documents_per_language``
    bounds (in the mean; documents are taken by hash of their text, up to that many) what is learnt from;
    whole texts are used.  A language with few documents that share no n-gram, as with a single one, has
    all their n-grams.  Null labels and texts teach nothing; without any labelled row there is no language
    and every prediction is ``und``.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    rows = rows.withColumn("content", F.xxhash64("text"))
    counts = {r.lang: r["count"] for r in rows.select("lang", "content").distinct().groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((1, 1 << TABLE_BITS), np.uint64))
    chosen = F.lit(False)
    for name, n in counts.items():
        take = int(min(1.0, documents_per_language / n) * (1 << 31))
        chosen = chosen | ((F.col("lang") == name) & (F.shiftrightunsigned("content", 33) < take))
    # One row per text: first in each task, so a million copies send one row a task.
    sample = (rows.where(chosen).mapInArrow(_first_copies, "text string, lang string, content long")
              .dropDuplicates(["lang", "content"]))
    few = [name for name, n in counts.items() if least_share * min(n, documents_per_language) < 2]
    sums = materialise(sample.mapInArrow(_gram_documents, "lang string, gram long, documents long")
                       .groupBy("lang", "gram").agg(F.sum("documents").alias("documents"))
                       .where((F.col("documents") >= 2) | F.col("gram").isNull() | F.col("lang").isin(few)), "grams")
    sizes = {r.lang: r.documents for r in sums.where("gram IS NULL").collect()}
    table = np.zeros((-(-len(langs) // 64), 1 << TABLE_BITS), np.uint64)
    for i, name in enumerate(langs):
        # Bounded by the sample: an n-gram needs a fixed share of the sampled documents.
        own = sums.where((F.col("lang") == name) & F.col("gram").isNotNull())
        least = max(2, least_share * sizes.get(name, 0))
        found = own.where(F.col("documents") >= least).select("gram").collect()
        if not found and name in few:
            found = own.select("gram").collect()
        hashes = np.array([r.gram for r in found], np.int64).view(np.uint64)
        word, bit = divmod(i, 64)
        for place in _places(hashes):
            np.bitwise_or.at(table[word], place, np.uint64(1) << np.uint64(bit))
    return LanguageModel(langs, table)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, text):
            names, scores = [], []
            shares = model.shares(*utf8(piece.column(text)))
            for row, value in zip(shares, piece.column(text).to_pylist()):
                if not value or not model.langs or not _LETTER.search(value):
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(np.argmax(row))
                    names.append(model.langs[best])
                    scores.append(float(row[best]))
            others = [piece.column(c) for c in piece.schema.names if c != text]
            kept = [c for c in piece.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*others, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*kept, "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1) for every row.

    Null texts and texts without a letter are ``und`` with score 0; a text too short for an n-gram,
    or without a known one, gets the first language with score 0; ties go to the first by name.
    Repeated rows are judged alike; an empty table gives no rows.  Kept columns named ``lang_pred`` or
    ``score`` give way to the results.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(partial(_predict, model=model, text="__text"), f"{types}, lang_pred string, score double")
