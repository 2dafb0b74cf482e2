"""Base forms of nouns: detachment rules, irregular forms, and the words the texts themselves know.

A table (token, lemma) is learnt from a vocabulary once, kept beside the model and joined by training and prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill import constants as K

_IRREGULAR, _SLOTS, _DIGEST, _ENTRIES = "__irregular", "__slots", "__digest", "__entries"
#: Rows of a lemma table that every task may hold, a few MB.
FEW_LEMMAS = 50_000


def base_forms(token: Column) -> Column:
    """Every form a rule gives, as an array; forms that rules give twice are there once."""
    forms = [F.when(token.endswith(ending), F.concat(F.left(token, F.length(token) - len(ending)), F.lit(base)))
             for ending, base in K.NOUN_ENDINGS]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def lemma_table(vocabulary: DataFrame) -> DataFrame:
    """(token, lemma) for each token of ``vocabulary`` (one column ``token``, repeats allowed) that has another base form.

    A form counts only if it is a token itself.  An irregular form beats the rules; of several forms the shortest wins,
    then the smaller.  Null tokens have no lemma; an empty vocabulary gives an empty table.
    """
    known = vocabulary.where("token IS NOT NULL").select("token").distinct()
    irregular = vocabulary.sparkSession.createDataFrame(list(K.IRREGULAR_NOUNS.items()), f"token string, {_IRREGULAR} string")
    forms = known.join(F.broadcast(irregular), "token", "left")
    by_rule = F.transform(base_forms(F.col("token")), lambda f: F.struct(F.lit(1).alias("rank"), f.alias("lemma")))
    by_list = F.array(F.struct(F.lit(0).alias("rank"), F.col(_IRREGULAR).alias("lemma")))
    found = forms.select("token", F.inline(F.concat(by_list, by_rule))).where("lemma IS NOT NULL")
    found = found.join(known.select(F.col("token").alias("lemma")), "lemma", "left_semi")
    best = F.min(F.struct("rank", F.length("lemma").alias("length"), "lemma"))
    return (found.groupBy("token").agg(best.alias("best")).select("token", F.col("best.lemma").alias("lemma"))
            .where("token <> lemma"))


def fit_lemmas(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The lemma table of all tokens in ``df``."""
    return lemma_table(df.select(F.explode(tokens).alias("token")))


def _slots(lemmas: DataFrame, n: int) -> Column:
    """The table as an array of ``n`` small maps, a token's map being the one at its hash: one value for all rows."""
    entry = F.struct("token", "lemma")
    filled = lemmas.groupBy(_slot(F.col("token"), n).alias("slot")).agg(F.collect_list(entry).alias("entries"))
    dense = lemmas.sparkSession.range(n).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    ordered = F.array_sort(F.collect_list(F.struct("slot", "entries")))
    return dense.agg(F.transform(ordered, lambda s: F.map_from_entries(s["entries"])).alias("slots")).scalar()


def _slot(token: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(n)).cast("int")


def lemmatise(df: DataFrame, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Replace the tokens that the table knows; other columns and the number of rows stay.

    A table of at most ``FEW_LEMMAS`` rows goes to every task as one value and the texts stay where they are; a larger
    one is joined.  Null and empty arrays stay.
    """
    n = lemmas.limit(FEW_LEMMAS + 1).count()
    if n > FEW_LEMMAS:
        return _lemmatise_by_join(df, tokens, lemmas)
    if n == 0:
        return df
    rows = df.withColumn(_SLOTS, _slots(lemmas.select("token", "lemma"), n))
    found = F.transform(tokens, lambda t: F.coalesce(F.element_at(F.get(_SLOTS, _slot(t, n)), t), t))
    return rows.withColumn(tokens, found).drop(_SLOTS)


def _lemmatise_by_join(df: DataFrame, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Equal token arrays are looked up once, under a digest, so copies weigh no more than one text, and the looked-up
    tokens meet again where their text already lies.
    """
    digest = F.sha2(F.to_json(tokens), 256)
    rows = df.withColumn(_DIGEST, digest)
    texts = rows.where(F.size(tokens) > 0).groupBy(_DIGEST).agg(F.first(tokens).alias("words"))
    single = texts.select(_DIGEST, F.posexplode("words").alias("at", "token"))
    mapped = single.join(lemmas.select("token", "lemma"), "token", "left").select(
        _DIGEST, F.struct("at", F.coalesce("lemma", "token").alias("t")).alias("entry"))
    back = mapped.groupBy(_DIGEST).agg(F.array_sort(F.collect_list("entry")).alias(_ENTRIES))
    # Columns that nobody reads afterwards do not travel.
    return rows.join(back, _DIGEST, "left").select(*[
        F.coalesce(F.col(f"{_ENTRIES}.t"), F.col(f"`{c}`")).alias(c) if c == tokens else F.col(f"`{c}`") for c in df.columns])
