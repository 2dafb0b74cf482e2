"""Evaluation of classifiers and regressors as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.operators.metrics import histogram
from trendmill.operators.ranks import exact_quantiles, prefix_totals
from trendmill.session import materialise


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n): at most classes x classes rows from here on."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """One row per actual class, one column per predicted class in ``labels``."""
    counts = confusion_counts(df, actual, predicted)
    cells = [F.coalesce(F.sum(F.when(F.col("predicted") == v, F.col("n"))), F.lit(0)).alias(f"p_{v}")
             for v in labels]
    return counts.groupBy("actual").agg(*cells)


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen; 0 where undefined."""
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("called"), F.lit(0).cast("long").alias("hits")))))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    precision, recall = F.col("precision"), F.col("recall")
    return (
        sums.withColumns({"precision": ratio(F.col("hits"), F.col("called")),
                          "recall": ratio(F.col("hits"), F.col("support"))})
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, in one row."""
    total = F.sum("support")

    def weighted(c):
        return F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c)

    return per_class(confusion_counts(df, actual, predicted)).agg(
        total.alias("total_samples"),
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        weighted("precision"), weighted("recall"), weighted("f1"),
        F.count_if(F.col("support") > 0).alias("classes_actual"),
        F.count_if(F.col("called") > 0).alias("classes_predicted"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A row per class and the macro and weighted averages."""
    classes = per_class(confusion_counts(df, actual, predicted))
    named = classes.select(F.col("class").cast("string").alias("label"),
                           "precision", "recall", "f1", "support")
    macro = classes.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                        F.sum("support").alias("support"))
    weighted = classes.agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
          for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return named.unionByName(macro).unionByName(weighted)


def regression_metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row of error figures, from a single aggregate over the rows."""
    rows = df.select(actual.cast("double").alias("y"), predicted.cast("double").alias("p")).where(
        "y IS NOT NULL AND p IS NOT NULL")
    y, p = F.col("y"), F.col("p")
    residual = y - p
    mse = F.avg(residual * residual)
    relative = F.avg(F.when(y != 0, F.abs(residual / F.when(y != 0, y))))
    return rows.agg(
        F.count("*").alias("samples"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(residual)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop("y"))).alias("r2"),
        (1 - F.try_divide(F.var_pop(residual), F.var_pop("y"))).alias("explained_variance"),
        F.coalesce(relative, F.lit(0.0)).alias("mape"),
        (F.coalesce(relative, F.lit(0.0)) * 100).alias("mape_pct"),
        F.avg(residual).alias("residual_mean"), F.stddev_pop(residual).alias("residual_std"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a binary label, with ties counted half.

    Rows are first counted per score; ranks come from binned running totals, so
    neither the sort nor a hot score sits in one task.
    """
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(
        F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    ranked = prefix_totals(counts, "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    return ranked.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def compare_models(metrics: DataFrame, metric: str) -> DataFrame:
    """Models that have ``metric``, best first.  ``metrics``: model, model_type, one column per metric."""
    return metrics.where(F.col(metric).isNotNull()).select(
        "model", F.col(metric).alias("metric_value"), "model_type").orderBy(
        F.desc("metric_value"), "model")


def best_models_report(metrics: DataFrame) -> DataFrame:
    """Best classifier by accuracy, best regressor by r2, and how many there are."""
    def best(kind, metric):
        return F.max_by("model", F.when(F.col("model_type") == kind, F.col(metric)))

    return metrics.agg(
        F.count("*").alias("total_models"),
        F.count_if(F.col("model_type") == "classification").alias("classification_models"),
        F.count_if(F.col("model_type") == "regression").alias("regression_models"),
        best("classification", "accuracy").alias("best_classifier"),
        F.max(F.when(F.col("model_type") == "classification", F.col("accuracy"))).alias("best_accuracy"),
        best("regression", "r2").alias("best_regressor"),
        F.max(F.when(F.col("model_type") == "regression", F.col("r2"))).alias("best_r2"))


def _nlp_rows(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    known = F.col(actual).isin(*K.CATEGORY_TITLES)
    return df.where(F.col(predicted).isNotNull() & (F.col(predicted) != -1) & known)


def evaluate_nlp(df: DataFrame, actual: str = "category_id",
                 predicted: str = "nlp_predicted_category") -> DataFrame:
    scored = classification_metrics(_nlp_rows(df, actual, predicted), actual, predicted)
    return scored.withColumn("meets_threshold", F.col("accuracy") >= K.NLP_ACCURACY_GATE)


def category_accuracy(df: DataFrame, actual: str = "category_id",
                      predicted: str = "nlp_predicted_category") -> DataFrame:
    hit = F.col(actual) == F.col(predicted)
    return _nlp_rows(df, actual, predicted).groupBy(F.col(actual).alias("category_id")).agg(
        F.count("*").alias("samples"), F.avg(hit.cast("double")).alias("accuracy"))


def evaluate_engagement(df: DataFrame) -> DataFrame:
    """Regression figures for predicted views and engagement, one row per target."""
    valid = df.where("views IS NOT NULL AND ml_predicted_views IS NOT NULL AND views > 0")
    views = regression_metrics(valid, F.col("views"), F.col("ml_predicted_views"))
    rate = regression_metrics(valid, F.col("engagement_rate"), F.col("ml_predicted_engagement_rate"))
    both = views.withColumn("target", F.lit("views")).unionByName(
        rate.withColumn("target", F.lit("engagement_rate")))
    return both.withColumn("meets_threshold", F.col("r2") >= K.R2_GATE)


def residual_distribution(df: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the residuals actual - predicted."""
    residuals = df.select((F.col("views") - F.col("ml_predicted_views")).alias("residual"))
    return histogram(residuals, "residual", bins)


def residual_quantiles(df: DataFrame) -> DataFrame:
    """Exact quantiles of the residuals, which are written once: the ranks take several passes."""
    residuals = materialise(df.select((F.col("views") - F.col("ml_predicted_views")).alias("residual")), "residuals")
    return exact_quantiles(residuals, [], "residual",
                           {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
