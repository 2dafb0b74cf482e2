"""Splits, weights and models."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trendmill.models import engagement, nlp, text
from trendmill.models.split import mark_train


def videos(spark, n=240):
    """Two topics that their words tell apart, one video without text."""
    i = F.col("id")
    words = F.when(i % 2 == 0, F.concat(F.lit("cooking pasta recipe kitchen sauce number"), i % 5)).otherwise(
        F.lit("gaming highlights console battle victory"))
    return spark.range(n).select(
        F.concat(F.lit("v"), i).alias("video_id"), words.alias("title"),
        F.when(i == 7, F.lit(None).cast("string")).otherwise(F.concat(F.lit("about "), words)).alias("description"),
        F.lit("tag one|tag two").alias("tags"), F.when(i % 2 == 0, 26).otherwise(20).alias("category_id"))


def test_split_is_stratified_exact_and_repeatable(spark):
    # One label owns most rows.
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"),
                                  F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 3 + 1).alias("label"))
    marked = mark_train(df, "key", "label")
    shares = {r.label: (r.t, r.n) for r in marked.groupBy("label").agg(
        F.count_if("is_train").alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == math.floor(n * 0.8 + 0.5) for t, n in shares.values())
    again = mark_train(df.repartition(7), "key", "label")
    assert marked.exceptAll(again).count() == 0


def test_vector_and_relational_weights_agree(spark):
    rows = text.combine_text(videos(spark)).withColumn("terms", text.terms(F.col("tokens")))
    stages = text.fit_tfidf(rows)
    terms = stages[0].vocabulary
    vectors = PipelineModel(stages).transform(rows).select(
        "video_id", F.posexplode(vector_to_array("features")).alias("i", "w")).where("w > 0").collect()
    ml = {(r.video_id, terms[r.i]): r.w for r in vectors}
    relational = {(r.video_id, r.term): r.weight for r in text.tfidf_weights(rows, "video_id").collect()}
    assert ml.keys() == relational.keys()
    assert all(ml[k] == pytest.approx(relational[k]) for k in ml)


def test_text_model_learns_scores_and_survives_saving(spark, tmp_path):
    df = videos(spark)
    model = nlp.train_text_model(df, folds=2)
    assert model.metrics["accuracy"] == 1.0 and model.metrics["meets_threshold"]
    extra = df.unionByName(df.limit(1).withColumns({
        "video_id": F.lit("none"), "title": F.lit("a"), "description": F.lit(""), "tags": F.lit("")}))
    nlp.save_text_model(model, str(tmp_path / "m"))
    scored = {r.video_id: r for r in nlp.predict_categories(extra, nlp.load_text_model(str(tmp_path / "m"))).collect()}
    assert (scored["none"].nlp_predicted_category, scored["none"].nlp_category_confidence) == (-1, 0.0)
    known = [r for k, r in scored.items() if k != "none"]
    assert all(r.nlp_predicted_category == r.category_id and 0.5 < r.nlp_category_confidence <= 1 for r in known)
    assert nlp.feature_importance(df, model).count() == 20


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        nlp.train_text_model(videos(spark, 40), folds=2)


def test_regressors_see_no_targets_and_predict_on_the_view_scale(spark):
    i = F.col("id")
    df = spark.range(600).select(
        F.concat(F.lit("v"), i).alias("video_id"), (i % 30).alias("tag_count"), (i % 7).alias("publish_hour"),
        (F.exp((i % 30) / 3.0) * 100).cast("long").alias("views"), (i % 7 / 100.0).alias("engagement_rate"),
        F.lit(1.0).alias("log_views"), F.lit(2.0).alias("like_rate"))
    df = df.unionByName(df.limit(1).withColumns({"video_id": F.lit("zero"), "views": F.lit(0).cast("long")}))
    rows, names = engagement.training_set(df)
    assert names == ["tag_count", "publish_hour"] and rows.count() == 600
    models = engagement.train_models(df, folds=0, trees=5, rounds=3, depth=(6, 3))
    assert len(models) == 4
    best = engagement.best_models(models)
    assert best["views"].metrics["test_r2"] > 0.9
    scored = {r.video_id: r for r in engagement.predict_engagement(df, best).collect()}
    assert scored["zero"].ml_predicted_views is None
    assert scored["v29"].ml_predicted_views > 50 * scored["v0"].ml_predicted_views >= 0
