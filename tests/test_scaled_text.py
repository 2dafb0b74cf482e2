"""Lemmas without a shuffle of texts, tf-idf that counts only its vocabulary by row, fits and folds beside each other."""

import pytest
from pyspark.sql import functions as F

from trendmill.models import crossfit, engagement, lemmas, store, text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def token_rows(spark):
    return spark.createDataFrame(
        [(1, ["cats", "dog", "cats"]), (2, ["dog", None, "boxes"]), (3, []), (4, None), (1, ["cats", "dog", "cats"])],
        "id long, tokens array<string>")


def test_a_small_lemma_table_moves_no_texts(spark, monkeypatch):
    df = token_rows(spark)
    table = spark.createDataFrame([("cats", "cat"), ("boxes", "box"), ("geese", "goose")], "token string, lemma string")
    small = lemmas.lemmatise(df, "tokens", table)
    assert small.columns == df.columns and "Exchange" not in plan(small).split("Subquery")[0]
    found = sorted(map(str, small.collect()))
    assert str(small.where("id = 2").first().tokens) == "['dog', None, 'box']"
    assert lemmas.lemmatise(df, "tokens", table.limit(0)).collect() == df.collect()
    monkeypatch.setattr(lemmas, "FEW_LEMMAS", 2)
    joined = lemmas.lemmatise(df, "tokens", table)
    assert "Exchange" in plan(joined) and sorted(map(str, joined.collect())) == found


def weights(df):
    return {(r.doc_id, r.term): r.weight for r in text.tfidf_weights(df, "doc_id").collect()}


def test_only_the_vocabulary_is_counted_by_row(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["one", "two", f"word{i % 3}"]) for i in range(9)] + [(9, ["other", "one"])],
                               "doc_id long, tokens array<string>")
    monkeypatch.setattr(text, "_key_vocabulary", None)  # no key repeats, so terms are not counted by row for it
    once = weights(df)
    monkeypatch.undo()
    monkeypatch.setattr(text, "vocabulary", lambda df, tokens, *limits: text._key_vocabulary(df, "doc_id", tokens, *limits))
    assert once == pytest.approx(weights(df))


def test_rows_of_one_key_count_as_one_document(spark):
    df = spark.createDataFrame([(1, ["a1", "b1"]), (1, ["a1", "c1"]), (2, ["a1", "b1"]), (3, ["c1", "d1"]), (4, ["e1"])],
                               "doc_id long, tokens array<string>")
    found = weights(df)
    # a1 is in two keys of five rows, twice in key 1; b1 and "a1 b1" and c1 in two keys, once each.
    assert {t for k, t in found if k == 1} == {"a1", "b1", "a1 b1", "c1"}
    assert found[(1, "a1")] == pytest.approx(2 * found[(1, "b1")])


def test_all_four_engagement_models_are_fitted_beside_each_other(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(engagement, "fit_once", lambda rows, names, target, learner, folds: engagement.Regressor(
        type(learner).__name__, target, names, None, {}))
    monkeypatch.setattr(engagement, "side_by_side", lambda fits, n: calls.append((len(fits), n)) or [f() for f in fits])
    df = spark.range(200).select(F.col("id").cast("string").alias("video_id"), (F.col("id") + 1).alias("views"),
                                 F.lit(0.1).alias("engagement_rate"), (F.col("id") % 7).alias("tag_count"))
    assert list(engagement.train_models(df)) == [
        (t, k) for t in ("views", "engagement_rate") for k in ("RandomForestRegressor", "GBTRegressor")]
    assert calls == [(4, 4)]


def test_boosting_has_places_beside_the_forests():
    held = [store._SLOTS.acquire() for _ in range(store.PARALLEL_FITS)]
    try:
        assert store.fit_side_by_side([lambda: 7], light=True) == [7]
    finally:
        for _ in held:
            store._SLOTS.release()


def test_folds_are_scored_side_by_side(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(crossfit, "side_by_side", lambda fits, n: calls.append((len(fits), n)) or [f() for f in fits])
    i = F.col("id")
    df = spark.range(200).select(F.concat(F.lit("v"), i).alias("video_id"), F.lit("music video").alias("title"),
                                 F.when(i % 2 == 0, "guitar piano concert").otherwise("football match goal").alias("description"),
                                 F.lit("tag").alias("tags"), F.when(i % 2 == 0, 10).otherwise(17).alias("category_id"))
    found = crossfit.cross_fitted_categories(df, 3).join(df, "video_id")
    assert calls == [(3, 3)] and found.where("nlp_predicted_category = category_id").count() == 200
