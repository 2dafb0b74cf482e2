"""Quality rules: counts inside a document, and lines that many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendmill.session import materialise

_BLANKS = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_DIGITS = str.maketrans("123456789", "000000000")
#: Up to so many frequent lines travel with the code (8 bytes each); more are joined to the documents.
CARRIED_LINES = 200_000


def line_key(host: str | None, line: str) -> int:
    """64-bit hash of a host and a normalised line: lower case, single blanks, digits alike."""
    plain = " ".join(line.lower().split()).translate(_DIGITS)
    prefix = "\x00" if host is None else "\x01" + host
    return xxhash.xxh3_64_intdigest(f"{prefix}\x02{plain}") - (1 << 63)


def has_word(line: str) -> bool:
    return bool(line.strip(_BLANKS))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the list holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    often: set = set()
    for window in windows:
        (often if window in seen else seen).add(window)
    covered, reach = 0, 0
    for at, window in enumerate(windows):
        if window in often:
            covered += at + width - max(at, reach)
            reach = at + width
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if has_word(line)]
    repeats = repeated_words(words)
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words))


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, lines): hash of the whole text and its distinct line keys."""
    for batch in batches:
        hosts, contents, lines = [], [], []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            hosts.append(host)
            contents.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
            lines.append([line_key(host, x) for x in {x for x in text.split("\n") if has_word(x)}])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(lines, pa.list_(pa.int64()))],
            ["host", "content", "lines"])


def frequent_lines(docs: DataFrame, min_documents: int = 10, share: float = 0.01,
                   text: str = "text", source: str = "source") -> DataFrame:
    """(line, documents): keys of lines above the limits of their host.

    Documents are counted by distinct content, so copies of one document don't make its lines
    frequent.  A line is above the limits in more than ``min_documents`` documents of the host
    and in more than ``share`` of them.
    """
    listed = materialise(docs.select(F.col(source).alias("host"), F.col(text).alias("text")).mapInArrow(
        _lines_of, "host string, content long, lines array<long>"), "lines")
    hosts = listed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all_documents"))
    counts = (listed.select("host", "content", F.explode("lines").alias("line")).distinct()
              .groupBy("host", "line").agg(F.count("*").alias("documents"))
              .where(F.col("documents") > min_documents))
    found = counts.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    return materialise(found.where(F.col("documents") > share * F.col("all_documents")).select("line", "documents"),
                       "frequent")


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed",
        "kept", "cleaned"]


def _judge(batches: Iterator[pa.RecordBatch], carried: frozenset | None, keep_share: float,
           schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of (host, text, [frequent keys]) and passengers; without ``carried`` the keys are a column."""
    for batch in batches:
        texts, hosts = batch.column("__text").to_pylist(), batch.column("__host").to_pylist()
        own = batch.column("__removed").to_pylist() if carried is None else None
        rows = []
        for i, (host, text) in enumerate(zip(hosts, texts)):
            counts = base_counts(text)
            often = carried if own is None else set(own[i] or ())
            lines = (text or "").split("\n")
            gone = [bool(often) and has_word(x) and line_key(host, x) in often for x in lines]
            lost = sum(len(x.encode("utf-8", "surrogatepass").split()) for x, out in zip(lines, gone) if out)
            kept = not counts[5] and counts[0] - lost >= keep_share * counts[0]
            cleaned = "\n".join(x for x, out in zip(lines, gone) if not out) if lost else text
            rows.append((*counts[:5], lost, counts[5], kept, cleaned))
        values = dict(zip(_OUT, zip(*rows))) if rows else {name: [] for name in _OUT}
        arrays = [pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name).cast(f.type)
                  for f in schema]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def apply_quality_rules(docs: DataFrame, min_documents: int = 10, share: float = 0.01, keep_share: float = 0.5,
                        text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with the base counts, n_removed_words, base_failed, kept and cleaned.

    ``cleaned`` is the text without the lines above the limits; ``kept`` is false if the base rules
    fail or if less than ``keep_share`` of the words are left.  Null text has no words and fails;
    a null source is a host of its own; rows are judged one by one, so repeated rows repeat.
    Input columns with names of the output are replaced.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*_OUT)
    lines = frequent_lines(docs, min_documents, share, text, source).select("line")
    rows = docs.withColumns({"__text": F.col(text), "__host": F.col(source)})
    carried = None
    if lines.count() <= CARRIED_LINES:
        carried = frozenset(r.line for r in lines.collect())
    else:
        rows = _with_own_lines(rows, lines)
    types = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "cleaned": T.StringType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, types.get(n, T.LongType())) for n in _OUT)])
    return rows.mapInArrow(partial(_judge, carried=carried, keep_share=keep_share,
                                   schema=to_arrow_schema(schema)), schema)


def _with_own_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows with their own frequent keys, joined by content; for more keys than may be carried."""
    content = F.xxhash64("__text", "__host")
    keyed = rows.withColumn("__content", content)
    own = (keyed.select("__host", "__text", "__content")
           .dropDuplicates(["__content"]).mapInArrow(_keys_by_content, "__content long, lines array<long>")
           .select("__content", F.explode("lines").alias("line")).join(lines, "line", "left_semi")
           .groupBy("__content").agg(F.collect_set("line").alias("__removed")))
    return keyed.join(own, "__content", "left").drop("__content")


def _keys_by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [[line_key(host, x) for x in {x for x in (text or "").split("\n") if has_word(x)}]
                 for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(lines, pa.list_(pa.int64()))],
                                         ["__content", "lines"])
