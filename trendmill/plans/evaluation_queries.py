"""E*: evaluation figures over predictions of models that did not see the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import table
from trendmill.operators import evaluate
from trendmill.plans.metric_queries import histogram_sql
from trendmill.plans.registry import query
from trendmill.plans.sqltext import enriched_sql, in_list
from trendmill.plans.tables import scored
from trendmill.session import materialise

ACTUAL, PREDICTED = "category_id", "nlp_predicted_category"

# Confusion cells, then per-class figures, for any (actual, predicted) rows.
_CLASSES = """cells AS (SELECT a, p, count(*) AS n FROM pairs GROUP BY 1, 2),
classes AS (
  SELECT class, support, called, hits, coalesce(hits / nullif(called, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2.0 * hits / nullif(called + support, 0), 0) AS f1
  FROM (SELECT class, sum(s) AS support, sum(c) AS called, sum(h) AS hits FROM (
      SELECT a AS class, n AS s, 0 AS c, CASE WHEN a = p THEN n ELSE 0 END AS h FROM cells
      UNION ALL SELECT p, 0, n, 0 FROM cells) GROUP BY 1))"""
_PAIRS = "pairs AS (SELECT category_id AS a, nlp_predicted_category AS p FROM enriched WHERE nlp_predicted_category IS NOT NULL)"
_KNOWN = _PAIRS[:-1] + f" AND nlp_predicted_category <> -1 AND category_id IN {in_list(K.CATEGORY_TITLES)})"
_SUMMARY = """CAST(sum(support) AS BIGINT) AS total_samples, sum(hits) / sum(support) AS accuracy,
  sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
  sum(f1 * support) / sum(support) AS f1, count(*) FILTER (support > 0) AS classes_actual,
  count(*) FILTER (called > 0) AS classes_predicted"""


def _scored(spark, sf):
    return scored(spark, sf).where(F.col(PREDICTED).isNotNull())


@query("classification_metrics", enriched_sql(f"SELECT {_SUMMARY} FROM classes", _PAIRS, _CLASSES),
       doubles="accuracy precision recall f1")
def classification_metrics(spark, sf):
    return evaluate.classification_metrics(_scored(spark, sf), ACTUAL, PREDICTED)


@query("classification_report", enriched_sql("""
SELECT CAST(class AS VARCHAR) AS label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM classes
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM classes""", _PAIRS, _CLASSES),
       doubles="precision recall f1")
def classification_report(spark, sf):
    return evaluate.classification_report(_scored(spark, sf), ACTUAL, PREDICTED)


_LABELS = list(range(1, 48))


@query("confusion_matrix", enriched_sql(
    "SELECT a AS actual, " + ", ".join(f"count(*) FILTER (p = {v}) AS p_{v}" for v in _LABELS)
    + " FROM pairs GROUP BY 1", _PAIRS))
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_scored(spark, sf), ACTUAL, PREDICTED, _LABELS)


def _errors(y: str, p: str) -> str:
    r = f"({y} - {p})"
    rel = f"coalesce(avg(abs({r} / nullif({y}, 0))), 0)"
    return f"""count(*) AS samples, avg({r} * {r}) AS mse, sqrt(avg({r} * {r})) AS rmse, avg(abs({r})) AS mae,
  1 - avg({r} * {r}) / var_pop({y}) AS r2, 1 - var_pop({r}) / var_pop({y}) AS explained_variance,
  {rel} AS mape, {rel} * 100 AS mape_pct, avg({r}) AS residual_mean, stddev_pop({r}) AS residual_std"""


_VALID = "ml_predicted_views IS NOT NULL AND views > 0"
_ERROR_DIGITS = "mse:-3 rmse:3 mae:4 r2 explained_variance mape mape_pct residual_mean:4 residual_std:3"


@query("regression_metrics", enriched_sql(f"""
SELECT {_errors('CAST(views AS DOUBLE)', 'ml_predicted_views')} FROM enriched
WHERE views IS NOT NULL AND ml_predicted_views IS NOT NULL"""), doubles=_ERROR_DIGITS)
def regression_metrics(spark, sf):
    return evaluate.regression_metrics(scored(spark, sf), F.col("views"), F.col("ml_predicted_views"))


@query("evaluate_engagement", enriched_sql(f"""
SELECT *, r2 >= 0.85 AS meets_threshold FROM (
  SELECT 'views' AS target, {_errors('CAST(views AS DOUBLE)', 'ml_predicted_views')} FROM enriched WHERE {_VALID}
  UNION ALL SELECT 'engagement_rate', {_errors('engagement_rate', 'ml_predicted_engagement_rate')}
  FROM enriched WHERE {_VALID} AND engagement_rate IS NOT NULL AND ml_predicted_engagement_rate IS NOT NULL)"""), doubles=_ERROR_DIGITS)
def evaluate_engagement(spark, sf):
    return evaluate.evaluate_engagement(scored(spark, sf))


@query("evaluate_nlp", enriched_sql(
    f"SELECT *, accuracy >= 0.85 AS meets_threshold FROM (SELECT {_SUMMARY} FROM classes)", _KNOWN, _CLASSES),
       doubles="accuracy precision recall f1")
def evaluate_nlp(spark, sf):
    return evaluate.evaluate_nlp(scored(spark, sf))


@query("category_accuracy", enriched_sql("""
SELECT a AS category_id, count(*) AS samples, avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END) AS accuracy
FROM pairs GROUP BY 1""", _KNOWN), doubles="accuracy")
def category_accuracy(spark, sf):
    return evaluate.category_accuracy(scored(spark, sf))


@query("roc_auc", """
SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality <> 1) AS negatives,
  (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0)
    / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1)) AS roc_auc
FROM (SELECT quality, rank() OVER (ORDER BY n_chars)
    + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r
  FROM documents JOIN labels USING (doc_id))""", doubles="roc_auc")
def roc_auc(spark, sf):
    """How well text length alone separates good from poor documents."""
    scored = table(spark, sf, "documents").select("doc_id", "n_chars").join(
        table(spark, sf, "labels"), "doc_id")
    return evaluate.roc_auc(scored, "quality", "n_chars")


@query("auc_rank", enriched_sql("""
SELECT count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS negatives,
  (sum(r) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0)
    / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS roc_auc
FROM (SELECT hit, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (
  SELECT nlp_category_confidence AS s, nlp_predicted_category = category_id AS hit FROM enriched
  WHERE nlp_predicted_category IS NOT NULL))"""), doubles="roc_auc")
def auc_rank(spark, sf):
    """Does confidence rank correct predictions above wrong ones?  Few distinct scores, many ties."""
    hits = _scored(spark, sf).select(
        (F.col(PREDICTED) == F.col(ACTUAL)).cast("int").alias("hit"), "nlp_category_confidence")
    return evaluate.roc_auc(hits, "hit", "nlp_category_confidence")


def model_metrics(spark, sf):
    """One row per evaluated target: the table the comparisons read.

    The columns of the three evaluations are written once rather than joined three times.
    """
    df = materialise(scored(spark, sf).select(
        "views", "engagement_rate", "ml_predicted_views", "ml_predicted_engagement_rate", ACTUAL, PREDICTED), "evaluated")
    regress = evaluate.evaluate_engagement(df).select(
        F.concat(F.col("target"), F.lit("_prediction")).alias("model"), F.lit("regression").alias("model_type"),
        F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("f1"), "r2", "rmse")
    classify = evaluate.evaluate_nlp(df).select(
        F.lit("nlp_categorization").alias("model"), F.lit("classification").alias("model_type"), "accuracy", "f1",
        F.lit(None).cast("double").alias("r2"), F.lit(None).cast("double").alias("rmse"))
    return regress.unionByName(classify)


MODEL_METRICS = f"""models AS (
  SELECT 'views_prediction' AS model, 'regression' AS model_type, CAST(NULL AS DOUBLE) AS accuracy,
    CAST(NULL AS DOUBLE) AS f1, r2, rmse
  FROM (SELECT {_errors('CAST(views AS DOUBLE)', 'ml_predicted_views')} FROM enriched WHERE {_VALID})
  UNION ALL SELECT 'engagement_rate_prediction', 'regression', NULL, NULL, r2, rmse
  FROM (SELECT {_errors('engagement_rate', 'ml_predicted_engagement_rate')} FROM enriched
    WHERE {_VALID} AND engagement_rate IS NOT NULL AND ml_predicted_engagement_rate IS NOT NULL)
  UNION ALL SELECT 'nlp_categorization', 'classification', accuracy, f1, NULL, NULL
  FROM (SELECT {_SUMMARY} FROM classes))"""


def models_sql(body: str) -> str:
    return enriched_sql(body, _KNOWN, _CLASSES, MODEL_METRICS)


@query("compare_models", models_sql(
    "SELECT model, r2 AS metric_value, model_type FROM models WHERE r2 IS NOT NULL"), doubles="metric_value")
def compare_models(spark, sf):
    return evaluate.compare_models(model_metrics(spark, sf), "r2")


@query("best_models_report", models_sql("""
SELECT count(*) AS total_models, count(*) FILTER (model_type = 'classification') AS classification_models,
  count(*) FILTER (model_type = 'regression') AS regression_models,
  arg_max(model, accuracy) AS best_classifier, max(accuracy) AS best_accuracy,
  arg_max(model, r2) AS best_regressor, max(r2) AS best_r2 FROM models"""), doubles="best_accuracy best_r2")
def best_models_report(spark, sf):
    return evaluate.best_models_report(model_metrics(spark, sf))


_RESIDUALS = "points AS (SELECT views - ml_predicted_views AS x FROM enriched WHERE ml_predicted_views IS NOT NULL)"


@query("residual_distribution", enriched_sql(histogram_sql("x", 50), _RESIDUALS),
       doubles="bin_start:3 bin_end:3 mean:3 stddev:3")
def residual_distribution(spark, sf):
    return evaluate.residual_distribution(scored(spark, sf))


@query("residual_quantiles", enriched_sql(
    "SELECT " + ", ".join(f"quantile_cont(x, {p}) AS p{p[2:]}" for p in ("0.05", "0.25", "0.50", "0.75", "0.95"))
    + " FROM points", _RESIDUALS), doubles="p05 p25 p50 p75 p95")
def residual_quantiles(spark, sf):
    return evaluate.residual_quantiles(scored(spark, sf))
