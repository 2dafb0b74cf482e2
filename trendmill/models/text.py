"""From raw text to weighted terms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendmill.functions import text
from trendmill.session import materialise, spread

MAX_TERMS = 10_000
MIN_DF = 2
MAX_DF = 0.8
MIN_TEXT = 10


def preprocess_text(column: Column) -> Column:
    """Cleaned tokens as one string."""
    return F.concat_ws(" ", text.model_tokens(column))


def combine_text(df: DataFrame, out: str = "tokens") -> DataFrame:
    """Adds the cleaned tokens of title (twice), description and tags."""
    whole = text.combined_text(F.col("title"), F.col("description"), F.col("tags"))
    return df.withColumn(out, text.model_tokens(whole))


def has_text(tokens: Column) -> Column:
    """More than ten characters once the tokens are joined."""
    return F.length(F.concat_ws(" ", tokens)) > MIN_TEXT


def terms(tokens: Column) -> Column:
    """Single tokens followed by pairs of neighbours."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - 1),
        lambda i: F.concat_ws(" ", F.element_at(tokens, i.cast("int")), F.element_at(tokens, (i + 1).cast("int"))))
    none = F.array().cast("array<string>")
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(none))


def vocabulary(df: DataFrame, tokens: str = "tokens", max_terms: int = MAX_TERMS,
               min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """(term, idf, total): the ``max_terms`` most frequent terms; ties go to the smaller term.

    idf = ln((1 + n) / (1 + df)) + 1.
    """
    n = df.agg(F.count("*")).scalar()
    return _most_frequent(
        df.select(F.inline(_entries(terms(F.col(tokens)))))
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total")), n, max_terms, min_df, max_df)


def _entries(every: Column) -> Column:
    """One entry per occurrence and one per document, to be added up on the map side:
    documents are not grouped by term, and rare pairs never travel with a key."""
    hits = F.transform(every, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    firsts = F.transform(F.array_distinct(every),
                         lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return F.concat(hits, firsts)


def _most_frequent(counts: DataFrame, n: Column, max_terms: int, min_df: int, max_df: float) -> DataFrame:
    """(term, idf, total) of the terms that are neither too rare nor too common among ``n`` documents."""
    return (
        counts.where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df)))
        .orderBy(F.desc("total"), "term").limit(max_terms)
        .select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"), "total")
    )


def fold_vocabularies(df: DataFrame, folds: int, every: str = "terms", max_terms: int = MAX_TERMS, min_df: int = MIN_DF,
                      max_df: float = MAX_DF) -> Callable[[int | None], DataFrame]:
    """``vocabulary`` of the rows outside a fold, or, for None, of all rows, from one pass over the texts.

    ``every`` holds the terms of a row, ``fold`` its fold from 0.  Counts are kept per term and fold in the shared folder;
    taking a fold's counts from the sums leaves those of the others.  A term too rare in all rows is too rare everywhere.
    """
    sizes = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one row per fold
    places = range(folds)
    counted = df.select("fold", F.inline(_entries(F.col(every)))).groupBy("term").agg(*(
        F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("df", "tf") for k in places))
    counted = materialise(counted.where(reduce(Column.__add__, (F.col(f"df_{k}") for k in places)) >= min_df), "terms")

    def outside(fold: int | None) -> DataFrame:
        kept = [k for k in places if k != fold]
        sums = [reduce(Column.__add__, (F.col(f"{c}_{k}") for k in kept)).alias(name) for c, name in (("df", "df"), ("tf", "total"))]
        n = F.lit(sum(sizes.get(k, 0) for k in kept)).cast("long")
        return _most_frequent(counted.select("term", *sums), n, max_terms, min_df, max_df)

    return outside


def term_counts(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, term, tf).  A frame that is partitioned by ``key`` is counted where it is."""
    return df.select(key, F.explode(terms(F.col(tokens))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _key_vocabulary(df: DataFrame, key: str, tokens: str, max_terms: int, min_df: int, max_df: float) -> DataFrame:
    """``vocabulary`` with the rows of one key taken as one document among as many as there are rows."""
    counts = term_counts(df, key, tokens).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return _most_frequent(counts, df.agg(F.count("*")).scalar(), max_terms, min_df, max_df)


def tfidf_weights(df: DataFrame, key: str, tokens: str = "tokens", max_terms: int = MAX_TERMS,
                  min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Length-one tf-idf weights as rows ``(key, term, weight)``, with the vocabulary of ``vocabulary``.

    ``key`` names a row; rows that share a key count as one.  The vocabulary holds at most ``max_terms`` terms, which
    bounds the broadcast.  It is found first, from the terms alone if no key repeats, so that only its terms are counted by row.
    ``df`` is read several times.
    """
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    known = (_key_vocabulary(df, key, tokens, max_terms, min_df, max_df) if repeated
             else vocabulary(df, tokens, max_terms, min_df, max_df)).select("term", "idf")
    found = spread(df, key).select(key, F.explode(terms(F.col(tokens))).alias("term")).join(F.broadcast(known), "term")
    raw = found.groupBy(key, "term").agg((F.count("*") * F.first("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def fit_tfidf(train: DataFrame, tokens: str = "tokens", out: str = "features", known: DataFrame | None = None):
    """ML stages over ``vocabulary(train)``, or over ``known`` if that is counted already, giving the weights of ``tfidf_weights`` as vectors.

    The stages read a column ``terms``.  At most ``MAX_TERMS`` rows come to the driver.
    """
    known = vocabulary(train, tokens) if known is None else known
    known = known.orderBy(F.desc("total"), "term").collect()
    if not known:
        raise ValueError("No term occurs often enough")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="terms", outputCol="tf")
    return [counter,
            ElementwiseProduct(inputCol="tf", outputCol="weighted", scalingVec=Vectors.dense([r["idf"] for r in known])),
            Normalizer(inputCol="weighted", outputCol=out, p=2.0)]
