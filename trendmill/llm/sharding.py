"""Histogram sort into shards of near equal size.

Rows are ordered by a 63-bit key: hash of the text, then hash of the id, so equal
texts stand together and a hot group of copies can still be cut.  Exact bytes
below a grid of probe keys are counted over all partitions; only the grid cells
that hold a shard's ideal border are probed again, 256 times finer, until a cell
is within the tolerance.  Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendmill.session import materialise

_KEY_BITS, _FIRST_BITS, _STEP_BITS, _LOW_BITS = 63, 16, 8, 31
#: Cells that hold more than this share of all bytes are cut for slot numbering.
_HEAVY = 1 / 16384


def text_bytes(text):
    """UTF-8 bytes plus one; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text, ident):
    high = F.shiftrightunsigned(F.xxhash64(text), 32)
    low = F.shiftrightunsigned(F.xxhash64(ident), 33)
    return F.shiftleft(high, _LOW_BITS).bitwiseOR(low)


def _cells(keys: DataFrame, bits: int, parents: list[int] | None, parent_bits: int) -> list[tuple[int, int]]:
    """(cell, bytes) in key order; at most 65536 cells, or 256 for each parent."""
    if parents is not None:
        keys = keys.where(F.shiftright("__key", _KEY_BITS - parent_bits).isin(parents))
    cells = keys.groupBy(F.shiftright("__key", _KEY_BITS - bits).alias("cell")).agg(F.sum("__size").alias("bytes"))
    return sorted((r.cell, r.bytes) for r in cells.collect())


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The ``shards - 1`` keys at which a new shard begins.  ``keys`` has __key and __size."""
    bits = _FIRST_BITS
    cells = _cells(keys, bits, None, 0)
    total = sum(size for _, size in cells)
    goals = {i: total * i // shards for i in range(1, shards)}
    found: dict[int, int] = {}
    spans = [(cells, 0)]  # sibling cells, and the bytes below the first of them
    while goals and total:
        active: dict[int, int] = {}
        for siblings, below in spans:
            ends = list(accumulate((size for _, size in siblings), initial=below))
            for i, goal in list(goals.items()):
                if not ends[0] <= goal < ends[-1]:
                    continue
                at = bisect_right(ends, goal) - 1
                cell, size = siblings[at]
                if size <= tolerance * total / shards or bits == _KEY_BITS:
                    up = goal - ends[at] > ends[at + 1] - goal
                    found[i] = (cell + up) << (_KEY_BITS - bits)
                    del goals[i]
                else:
                    active[cell] = ends[at]
        if not active:
            break
        finer = min(_KEY_BITS, bits + _STEP_BITS)
        children = _cells(keys, finer, sorted(active), bits)
        spans = [([c for c in children if c[0] >> (finer - bits) == cell], below) for cell, below in active.items()]
        bits = finer
    return [found.get(i, 0) for i in range(1, shards)]


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002,
                    text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with size, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    ``tolerance``: how far, in shares of a shard's ideal bytes, a border may be off; a group of
    equal texts that is smaller than that is not cut.  Null text has size 1; null ids are one id.
    Rows equal in text and id have one key and stay together.  An empty table gives no rows.
    Columns of ``docs`` named size, shard or slot are replaced; all others are kept.
    Runs one job that writes (key, size) and a few counting jobs over that.
    """
    docs = docs.drop("size", "shard", "slot")
    key = sort_key(F.col(text), F.col(ident))
    keys = materialise(docs.select(key.alias("__key"), text_bytes(F.col(text)).alias("__size")), "keys")
    borders = splitters(keys, shards, tolerance)

    cell = F.shiftright("__key", _KEY_BITS - _FIRST_BITS).cast("int").alias("__cell")
    # Heavy cells are cut by id hash into parts of about 1/65536 of all bytes: at most 16384 rows here.
    total = keys.agg(F.sum("__size")).first()[0] or 0
    heavy = F.broadcast(
        keys.groupBy(cell).agg(F.sum("__size").alias("__bytes")).where(F.col("__bytes") > F.lit(total * _HEAVY))
        .select("__cell", F.least(F.ceil(F.log2(F.col("__bytes") * (1 << _FIRST_BITS) / F.lit(max(total, 1)))),
                                  F.lit(20)).cast("int").alias("__cut")))

    def placed(df: DataFrame) -> DataFrame:
        low = F.col("__key").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
        shard = F.lit(0)
        for border in borders:
            shard = shard + (F.col("__key") >= F.lit(border)).cast("int")
        df = df.withColumn("shard", shard).withColumn("__cell", cell).join(heavy, "__cell", "left")
        part = F.expr(f"cast(shiftright(__key & {(1 << _LOW_BITS) - 1}L, {_LOW_BITS} - __cut) as int)")
        return df.withColumn("__part", F.coalesce(part, F.lit(0))).drop("__cut")

    place = ["shard", "__cell", "__part"]
    in_shard = Window.partitionBy("shard").orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    # At most some 200 000 rows whatever the input: 65536 cells, the parts of heavy ones, and cut cells.
    starts = F.broadcast(placed(keys).groupBy(place).agg(F.count("*").alias("__n"))
                         .withColumn("__start", F.coalesce(F.sum("__n").over(in_shard), F.lit(0))).drop("__n"))
    rows = placed(docs.withColumn("size", text_bytes(F.col(text))).withColumn("__key", key))
    number = F.row_number().over(Window.partitionBy(place).orderBy("__key", ident))
    return (rows.withColumn("__number", number).join(starts, place)
            .withColumn("slot", F.col("__start") + F.col("__number") - 1)
            .select(*docs.columns, "size", "shard", F.col("slot").cast("long").alias("slot")))
