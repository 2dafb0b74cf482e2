"""Sigmoids against plain Newton steps, and the probabilities of a margin classifier."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_models import videos
from trendmill.models import calibrate, nlp


def gradient(pairs, a, b):
    hits = sum(y for _, y in pairs)
    high, low = (hits + 1) / (hits + 2), 1 / (len(pairs) - hits + 2)
    d = [(m, (high if y else low) - 1 / (1 + math.exp(a * m + b))) for m, y in pairs]
    return sum(m * x for m, x in d), sum(x for _, x in d)


def test_sigmoids_are_the_best_fit(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(900):
        own = draw.randrange(3)
        rows.append((own, [draw.gauss(2.0 if c == own else -0.5, 1.5) for c in range(3)] + [1.0, draw.random()]))
    scored = spark.createDataFrame(rows, "label int, margins array<double>").repartition(4)
    found = calibrate.platt_sigmoids(scored, "label", F.col("margins"), 5)
    for c in range(3):
        pairs = [(m[c], own == c) for own, m in rows]
        assert max(map(abs, gradient(pairs, *found[c]))) < 1e-3 and found[c][0] < 0
        said = [1 / (1 + math.exp(found[c][0] * m + found[c][1])) for m, _ in pairs]
        assert sum(said) == pytest.approx(sum(y for _, y in pairs), abs=3)
    assert found[3][0] == found[4][0] == 0.0  # classes without rows keep their prior
    out = scored.select(calibrate.calibrated(F.col("margins"), found).alias("p")).collect()
    assert all(sum(r.p) == pytest.approx(1) and min(r.p) >= 0 for r in out)


def test_separable_and_one_sided_classes_stay_finite(spark):
    scored = spark.createDataFrame([(i % 2, [5.0, -5.0] if i % 2 == 0 else [-5.0, 5.0]) for i in range(60)],
                                   "label int, margins array<double>")
    found = calibrate.platt_sigmoids(scored, "label", F.col("margins"), 2)
    assert all(math.isfinite(a) and math.isfinite(b) and a < 0 for a, b in found)
    alone = calibrate.platt_sigmoids(scored.where("label = 0"), "label", F.col("margins"), 2)
    assert all(math.isfinite(a) and math.isfinite(b) for a, b in alone)
    assert calibrate.platt_sigmoids(scored.limit(0), "label", F.col("margins"), 2) == [(0.0, 0.0)] * 2


def test_margin_classifier_has_calibrated_confidence_and_keeps_it_when_saved(spark, tmp_path):
    df = videos(spark)
    model = nlp.train_text_model(df, "svm", folds=2, iterations=10)
    assert len(model.sigmoids) == 2 and all(a < 0 for a, _ in model.sigmoids)
    nlp.save_text_model(model, str(tmp_path / "svm"))
    loaded = nlp.load_text_model(str(tmp_path / "svm"))
    assert loaded.sigmoids == model.sigmoids and loaded.kind == "svm"
    first = nlp.predict_categories(df, model).orderBy("video_id").collect()
    assert first == nlp.predict_categories(df, loaded).orderBy("video_id").collect()
    assert all(r.nlp_predicted_category == r.category_id and 0.9 < r.nlp_category_confidence < 1 for r in first)
