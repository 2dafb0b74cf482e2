"""Evaluations of the scores read a joined table once, not once per pass."""

import pytest
from pyspark.sql import functions as F

from trendmill.operators import evaluate
from trendmill.plans import evaluation_queries


def scores(spark, n=101):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("views"), (i % 10 / 10.0).alias("engagement_rate"), (i - i % 3).cast("double").alias("ml_predicted_views"),
        (i % 10 / 10.0).alias("ml_predicted_engagement_rate"), (i % 2 + 1).cast("int").alias("category_id"),
        F.lit(1).alias("nlp_predicted_category"))


def test_residual_quantiles_read_written_residuals(spark):
    out = evaluate.residual_quantiles(scores(spark))
    assert out.inputFiles() and all("residuals" in f for f in out.inputFiles())
    assert out.first().asDict() == {"p05": 0.0, "p25": 0.0, "p50": 1.0, "p75": 2.0, "p95": 2.0}


def test_the_three_evaluations_read_one_written_table(spark, data, monkeypatch):
    monkeypatch.setattr(evaluation_queries, "scored", lambda *_: scores(spark))
    out = evaluation_queries.model_metrics(spark, data)
    assert out.inputFiles() and all("evaluated" in f for f in out.inputFiles())
    found = {r["model"]: r for r in out.collect()}
    assert found["engagement_rate_prediction"]["r2"] == pytest.approx(1.0)
    assert found["nlp_categorization"]["accuracy"] == pytest.approx(51 / 101)
