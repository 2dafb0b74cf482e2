"""Near duplicates by MinHash with tensored banding.

Two collections of short half keys are made from few minhashes; a table's key is a pair of one half
key from each, so m + m half keys serve m * m tables.  Documents that meet in a table are candidates;
they are linked only if their full shingle sets are similar enough, and links make components.

Documents with equal sets are one class throughout, numbered in a written table.  In a table's bucket not
all pairs are tried: members meet hubs of the bucket, and linked members are then one component.  Classes
of buckets that still hold several components are compared across components by their rarest shingles: sets
that are similar enough share one of each other's first few, so no candidate pair stays untried, and a
passage that thousands of different documents quote costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendmill.llm import tokens
from trendmill.llm.common import chunks, utf8
from trendmill.llm.exchange import free_shuffles
from trendmill.session import materialise

#: Half keys per collection and minhashes per half key: 256 tables of 8 minhashes out of 128.
#: At a similarity of 0.8 a pair meets in some table with probability (1 - (1 - 0.8^4)^16)^2 > 0.9995.
COLLECTION, HALF = 16, 4
#: Rounds of hubs before rare shingles, and hubs that a class is tried against in each.
ROUNDS, HUBS = 2, 3
#: Columns of a set's parity bits.
MARKS = ("m0", "m1", "m2", "m3")
#: Members that one verifying task takes of a hub at once.
GROUP = 256


def shingles(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all rows, and each row's first index; a short text is one shingle."""
    data, offsets = utf8(piece.column("__text"))
    data = tokens.lower_ascii(data)
    starts, ends, first = tokens.words(data, offsets)
    words = tokens.word_hashes(data, starts, ends)
    index, hashes = tokens.window_hashes(words, first, width)
    counts = np.bincount(np.searchsorted(first, index, "right") - 1, minlength=len(first) - 1)
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if not len(short):
        return hashes, np.concatenate([[0], np.cumsum(counts)])
    whole = np.array([int.from_bytes(xxhash.xxh3_64_digest(words[first[i]:first[i + 1]].tobytes()), "little")
                      for i in short], np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)])[short]
    counts[short] = 1
    return np.insert(hashes, at, whole), np.concatenate([[0], np.cumsum(counts)])


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (values[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (values[n:] >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, collection: int, half: int) -> Iterator[pa.RecordBatch]:
    """(__id, __content, n_shingles, digest, keys): digest of the set and its half keys, packed."""
    scale, shift = _coefficients(2 * collection * half)
    for batch in batches:
        for piece in chunks(batch, "__text", 2 << 20):
            hashes, first = shingles(piece, width)
            sizes, digests = [], []
            for a, b in zip(first, first[1:]):
                own = np.unique(hashes[a:b])
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            full = np.flatnonzero(np.diff(first))
            keys: list[bytes | None] = [None] * piece.num_rows
            if len(full):
                low = (hashes >> np.uint64(16)).astype(np.uint32)
                least = np.empty((len(scale), len(full)), np.uint32)
                for k in range(len(scale)):
                    least[k] = np.minimum.reduceat(low * scale[k] + shift[k], first[:-1][full])
                halves = np.zeros((2 * collection, len(full)), np.uint64)
                for k in range(len(scale)):
                    halves[k // half] = tokens.mix(halves[k // half] + least[k] + np.uint64(k // half + 1))
                rows = np.ascontiguousarray(halves.T)
                for at, row in zip(full.tolist(), rows):
                    keys[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [piece.column("__id"), piece.column("__content"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.binary())], ["__id", "__content", "n_shingles", "digest", "keys"])


def _half_keys(batches: Iterator[pa.RecordBatch], collection: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        place = pa.array(np.tile(np.arange(2 * collection, dtype=np.int32), n))
        owner = np.repeat(np.arange(n), 2 * collection)
        yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(owner)), place, pa.array(keys)],
                                         ["cls", "place", "half"])


def _tables(classes: DataFrame, collection: int) -> DataFrame:
    """(key, cls): the classes' tables, made only from half keys that another class has too."""
    halves = classes.select("cls", "keys").mapInArrow(partial(_half_keys, collection=collection),
                                                      "cls long, place int, half long")
    shared = halves.groupBy("place", "half").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = halves.join(shared, ["place", "half"], "left_semi")
    left, right = F.col("place") < collection, F.col("place") >= collection
    sides = own.groupBy("cls").agg(  # at most ``collection`` of each
        F.collect_list(F.when(left, F.struct("place", "half"))).alias("a"),
        F.collect_list(F.when(right, F.struct("place", "half"))).alias("b"))
    pairs = sides.select("cls", F.explode("a").alias("a"), "b").select("cls", "a", F.explode("b").alias("b"))
    return pairs.select(F.xxhash64("a.place", "a.half", "b.place", "b.half").alias("key"), "cls")


def _verify(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between a hub and some members, by their full sets."""
    table = table.combine_chunks()
    batch = table.select(["cls", "text"]).rename_columns(["cls", "__text"]).to_batches()[0]
    at = table.column("hub").to_pylist().index(True)
    center = np.unique(shingles(batch.slice(at, 1), width)[0])
    hub, found = batch.column("cls")[at].as_py(), []
    for piece in chunks(batch, "__text", 1 << 20):
        hashes, first = shingles(piece, width)
        for name, a, b in zip(piece.column("cls").to_pylist(), first, first[1:]):
            own = np.unique(hashes[a:b])
            both = len(np.intersect1d(center, own, assume_unique=True))
            if name != hub and 100 * both >= percent * (len(own) + len(center) - both):
                found.append(name)
    return pa.table([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar; a hub's text goes out once per group of members."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    spread = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    members = spread.select(F.col("b").alias("cls"), F.lit(False).alias("hub"), "a", "part")
    hubs = sizes.select(F.col("a").alias("cls"), F.lit(True).alias("hub"), "a",
                        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = members.unionByName(hubs).join(texts, "cls")
    full = spread.select("a", "part").distinct()  # a part may have got no member
    return (rows.join(full, ["a", "part"], "left_semi").groupBy("a", "part")
            .applyInArrow(lambda table: _verify(table, width, percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(cls, root) of all ends of the links: the least class that each is connected with.

    Large star and small star in turn: every class is tied to the least neighbour known, until
    all edges lead to roots.
    """
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        edges = materialise(edges, "edges")
        # Done when nothing has two targets, and no target has one itself.
        ends = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        open_ends = ends.groupBy("u").agg(F.sum("out").alias("outs"), F.min("out").alias("least"))
        if not open_ends.where("outs > 1 OR (outs > 0 AND least = 0)").head(1):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = small.where(F.col("u") != F.col("v")).distinct()
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())


def _extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` with further links, which join whole components."""
    if roots is None:
        return components(links)
    ends = _labelled(_labelled(links, roots, "a", "u"), roots, "b", "v")
    joined = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))
    moved = _labelled(roots.withColumnRenamed("root", "old"), joined, "old", "root").select("cls", "root")
    return materialise(moved.unionByName(joined.join(roots, "cls", "left_anti")), "roots")


def _open_buckets(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` (key, cls ...) with their root, of the buckets whose members are not one component yet."""
    named = _labelled(members, roots, "cls", "root")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialise(named.join(mixed.select("key"), "key", "left_semi"), "open")


def _hub_pairs(named: DataFrame, turn: int) -> DataFrame:
    """(a, b): each class with one hub, of those that its buckets offer the one offered most.

    A bucket offers two hubs of different components, so that every member meets another component.
    """
    rank = F.struct(F.xxhash64("cls", F.lit(turn)).alias("draw"), "cls", "root")
    first = named.groupBy("key").agg(F.min(rank).alias("first"))
    ranked = named.join(first, "key")
    away = F.col("root") != F.col("first.root")
    second = ranked.where(away).groupBy("key").agg(F.min(rank).alias("second"))
    hub = F.when(away, F.col("first.cls")).otherwise(F.col("second.cls"))
    offers = ranked.join(second, "key").select("cls", hub.alias("hub")).groupBy("cls", "hub").agg(F.count("*").alias("n"))
    best = offers.groupBy("cls").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    return best.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(cls, n, keys, m0 ...): the distinct shingles of each class, their number and 256 parity bits.

    Each shingle flips one bit, so two sets differ in at least as many shingles as in bits.
    """
    for batch in batches:
        for piece in chunks(batch, "__text", 1 << 20):
            hashes, first = shingles(piece, width)
            sets = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
            heads = np.concatenate([[0], np.cumsum([len(own) for own in sets])]).astype(np.int64)
            keys = np.concatenate(sets)
            place, bit = keys >> np.uint64(62), np.uint64(1) << (keys >> np.uint64(56) & np.uint64(63))
            marks = [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), heads[:-1]).view(np.int64)
                     for k in range(len(MARKS))]
            yield pa.RecordBatch.from_arrays(
                [piece.column("cls"), pa.array(np.diff(heads)),
                 pa.ListArray.from_arrays(heads.astype(np.int32), pa.array(keys.view(np.int64))),
                 *map(pa.array, marks)], ["cls", "n", "keys", *MARKS])


def _rare_shingles(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, cls, n, place, m0 ...): the first shingles of each set, rarest first, of which similar sets share one.

    Sets of n and more common shingles than ``percent`` of n meet within the first n - need + 1 of any
    common order; shingles of one set only keep their places but needn't be listed.
    """
    types = ", ".join(["cls long, n long, keys array<long>", *(f"{m} long" for m in MARKS)])
    sets = materialise(texts.select("cls", F.col("text").alias("__text")).mapInArrow(partial(_sets, width=width), types), "sets")
    every = sets.select("cls", "n", F.explode("keys").alias("key"))
    common = every.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("cls")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "key"))
    need = F.floor((F.col("n") * percent + 99) / 100)
    rare = (every.join(common, "key").withColumn("place", place).where(F.col("place") <= F.col("n") - need + 1)
            .select("key", "cls", "n", "place"))
    return rare.join(sets.select("cls", *MARKS), "cls")


def _rare_pairs(named: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a rare shingle, one outside its largest component.

    Behind the first shingle they share there must be room for the common ones they need, and their
    parity bits must not differ more than their sets may.
    """
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("largest"))
    mine = ["key", "cls", "root", "n", "place", *MARKS]
    outside = (named.join(largest, "key").where(F.col("root") != F.col("largest"))
               .select(*(F.col(c).alias(f"x_{c}") for c in mine)))
    both = F.col("n") + F.col("x_n")
    room = F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place")) + 1
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"x_{m}"))) for m in MARKS), F.lit(0))
    fits = ((F.col("root") != F.col("x_root")) & (F.least("n", "x_n") * 100 >= F.greatest("n", "x_n") * percent)
            & (room * (100 + percent) >= both * percent) & (apart * (100 + percent) <= both * (100 - percent)))
    return (named.join(outside, (F.col("key") == F.col("x_key")) & fits)
            .select(F.least("cls", "x_cls").alias("a"), F.greatest("cls", "x_cls").alias("b")).distinct())


def _labelled(rows: DataFrame, roots: DataFrame | None, column: str, out: str) -> DataFrame:
    if roots is None:
        return rows.withColumn(out, F.col(column))
    names = roots.select(F.col("cls").alias(column), F.col("root").alias("__root"))
    return rows.join(names, column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, collection: int = COLLECTION, half: int = HALF,
                    text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: __id, __content, n_shingles, component and component_id.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct
    ``width``-word shingles (words lower-cased in A-Z; a shorter text is one shingle).  component_id is
    the smallest id reachable.  Null or empty texts have no set and are linked with nothing; equal
    sets are linked.  Rows with a null id count, but never give the smallest id unless all are null.
    Links between different sets are found if the sets meet in one of the tables; what meets is verified.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).alias("__id"), F.xxhash64(text).alias("__content"), F.col(text).alias("__text"))
    types = f"__id {rows.schema['__id'].dataType.simpleString()}, __content long, n_shingles long, digest binary, keys binary"
    sketches = materialise(rows.mapInArrow(partial(_sketch, width=width, collection=collection, half=half), types), "sketches")
    classes = materialise(sketches.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("__id").alias("least"), F.min(F.struct("__id", "__content")).alias("shown"),
        F.first("keys").alias("keys")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = _tables(classes, collection)
    # Tables whose buckets have the same members say the same: one of them is enough.
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"))
    buckets = buckets.where("n > 1").groupBy("n", "sum").agg(F.min("key").alias("key"))
    members = materialise(members.join(buckets.select("key"), "key", "left_semi"), "members")
    free_shuffles(spark)
    shown = members.select("cls").distinct().join(classes.select("cls", "shown"), "cls")
    texts = materialise(shown.join(rows, F.col("shown.__id").eqNullSafe(rows["__id"])
                                   & (F.col("shown.__content") == rows["__content"]))
                        .select("cls", F.col("__text").alias("text")).dropDuplicates(["cls"]), "texts")
    free_shuffles(spark)

    # Members are tried against hubs of other components, those they share most tables with, which joins
    # nearly all there is to join; what then is in buckets of several components meets by rare shingles.
    roots, tried = None, None
    for turn in range(ROUNDS + 1):
        named = _open_buckets(members, roots)
        if not named.head(1):
            break
        if turn < ROUNDS:
            pairs = reduce(DataFrame.unionByName, (_hub_pairs(named, HUBS * turn + i) for i in range(HUBS))).distinct()
        else:
            rare = _rare_shingles(texts.join(named.select("cls").distinct(), "cls", "left_semi"), width, percent)
            pairs = _rare_pairs(_open_buckets(rare, roots), percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = materialise(_links(pairs, texts, width, percent), "links")
        if links.head(1):
            roots = _extended(roots, links)
        free_shuffles(spark)

    named = _labelled(classes.select("digest", "cls", "least"), roots, "cls", "root")
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    ids = materialise(named.join(smallest, "root").select("digest", "root", "smallest"), "components")
    return (sketches.join(ids, "digest", "left")
            .select("__id", "__content", "n_shingles", F.col("root").alias("component"),
                    F.when(F.col("root").isNull(), F.col("__id")).otherwise(F.col("smallest")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, one of those that tie.

    Rows without words are linked with nothing and all stay.
    """
    found = near_duplicates(docs, text=text, ident=ident, **options)
    # One representative per component; the rows without a set stay by their own key.
    chosen = (found.where(F.col("component").isNotNull()).groupBy("component")
              .agg(F.min(F.struct(F.col("__id").isNull().alias("late"), "__id", "__content")).alias("pick"))
              .select(F.col("pick.__id").alias("__id"), F.col("pick.__content").alias("__content"), F.lit(True).alias("__single")))
    empty = (found.where(F.col("component").isNull()).select("__id", "__content").distinct()
             .withColumn("__single", F.lit(False)))
    picked = chosen.unionByName(empty)
    keyed = docs.withColumn("__same", F.xxhash64(F.col(text)))
    rows = keyed.join(picked, F.col(ident).eqNullSafe(F.col("__id")) & (F.col("__same") == F.col("__content")))
    # Rows equal in id and text are copies of one: only one of them stays.
    one = rows.where("__single").dropDuplicates(["__id", "__content"])
    return one.unionByName(rows.where(~F.col("__single"))).select(*docs.columns)
