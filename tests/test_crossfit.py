"""Predictions come from models that did not see the rows they score."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendmill.models import crossfit

FOLDS = 5


def fold_of(key):
    return int(hashlib.md5(f"{key}#43".encode()).hexdigest()[:12], 16) % FOLDS


def videos(spark, n=600):
    i = F.col("id")
    words = F.when(i % 2 == 0, F.lit("cooking pasta recipe kitchen")).otherwise(F.lit("gaming highlights console battle"))
    return spark.range(n).select(
        F.concat(F.lit("v"), i).alias("video_id"), F.concat_ws(" ", words, F.concat(F.lit("w"), F.chr(97 + i % 26))).alias("title"),
        F.when(i == 7, F.lit(None).cast("string")).otherwise(words).alias("description"), F.lit("x|y").alias("tags"),
        F.when(i % 2 == 0, 26).otherwise(20).alias("category_id"), (i * 37 % 101).alias("likes"),
        F.when(i % 9 == 0, F.lit(None).cast("long")).otherwise(i * 53 % 89).alias("comments"),
        (F.length("title") + i % 5).cast("int").alias("title_length"), (i % 24).cast("int").alias("publish_hour"),
        F.when(i == 11, F.lit(0)).otherwise(100 + i * 7919 % 5003).cast("long").alias("views"),
        F.when(i == 13, F.lit(None).cast("double")).otherwise((i % 17) / 100.0).alias("engagement_rate"))


@pytest.fixture(scope="module")
def frame(spark):
    return videos(spark).repartition(4).cache()


def test_least_squares_equal_numpy_fold_by_fold(frame):
    rows = [r for r in frame.collect() if r.views > 0]
    x = np.array([[1.0, *((r[c] or 0) for c in crossfit.LINEAR_FEATURES)] for r in rows])
    y = np.array([[math.log1p(r.views), r.engagement_rate or 0.0] for r in rows])
    fold = np.array([fold_of(r.video_id) for r in rows])
    want = {}
    for k in range(FOLDS):
        solved = np.linalg.lstsq(x[fold != k], y[fold != k], rcond=None)[0]
        for r, (views, rate) in zip(np.array(rows, object)[fold == k], x[fold == k] @ solved):
            want[r[0]] = (round(max(math.expm1(views), 0)), max(rate, 0))
    got = {r.video_id: r for r in crossfit.cross_fitted_engagement(frame).collect()}
    assert got.keys() == want.keys() and "v11" not in got
    for key, (views, rate) in want.items():
        assert got[key].ml_predicted_views == views and got[key].ml_predicted_engagement_rate == pytest.approx(rate, abs=1e-8)


def test_rows_do_not_see_their_own_category(frame):
    plain = {r.video_id: r for r in crossfit.cross_fitted_categories(frame).collect()}
    truth = {r.video_id: r.category_id for r in frame.collect()}
    assert sum(plain[k].nlp_predicted_category == truth[k] for k in truth) == len(truth) == len(plain)
    # The truth of one fold is turned round: what is said about that fold must not change, about others it must.
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat("video_id", F.lit("#43"))), 1, 12), 16, 10).cast("bigint"), F.lit(FOLDS))
    turned = frame.withColumn("category_id", F.when(fold == 2, 46 - F.col("category_id")).otherwise(F.col("category_id")))
    other = {r.video_id: r for r in crossfit.cross_fitted_categories(turned).collect()}
    own = [k for k in truth if fold_of(k) == 2]
    assert own and all(other[k] == plain[k] for k in own)
    assert any(other[k].nlp_category_confidence != plain[k].nlp_category_confidence for k in truth if fold_of(k) != 2)


def test_unusable_and_unknown_rows(spark, frame):
    odd = frame.limit(2).withColumns({"video_id": F.concat(F.lit("odd"), F.monotonically_increasing_id().cast("string")),
                                      "title": F.lit("a"), "description": F.lit(None).cast("string"), "tags": F.lit("")})
    foreign = frame.limit(1).withColumns({"video_id": F.lit("foreign"), "category_id": F.lit(45)})
    got = {r.video_id: r for r in crossfit.cross_fitted_predictions(frame.unionByName(odd).unionByName(foreign)).collect()}
    unusable = [r for k, r in got.items() if k.startswith("odd")]
    assert len(unusable) == 2 and all((r.nlp_predicted_category, r.nlp_category_confidence) == (-1, 0.0) for r in unusable)
    assert got["foreign"].nlp_predicted_category in (20, 26) and got["v11"].ml_predicted_views is None
    with pytest.raises(ValueError):
        crossfit.cross_fitted_engagement(frame.limit(20))
    with pytest.raises(ValueError):
        crossfit.cross_fitted_categories(frame.limit(20))


def test_scaled_and_constant_features(spark):
    i = F.col("id")
    rows = spark.range(300).select(F.col("id").cast("string").alias("video_id"), (i + 1e9).alias("far"), F.lit(3.0).alias("same"),
                                   (i * 2.0 + 5).alias("target"))
    got = crossfit.cross_fitted_least_squares(rows, ["far", "same"], ["target"]).collect()
    assert len(got) == 300 and all(r.target == pytest.approx(int(r.video_id) * 2.0 + 5, abs=1e-4) for r in got)
