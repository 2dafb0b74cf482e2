"""Predictions of models that did not see the rows they score.

Every row belongs to one of ``folds`` parts by its key.  A part is scored by models fitted on the
other parts, so the scores of all rows can be compared with the truth.  The result is a
table of scores by key, which the analytics table joins.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.models import nlp
from trendmill.models.split import with_folds
from trendmill.models.store import side_by_side
from trendmill.models.text import combine_text, fold_vocabularies, has_text, terms
from trendmill.session import materialise, spread

FOLDS = 5
#: What the least squares read; null counts as 0.
LINEAR_FEATURES = ["likes", "comments", "title_length", "publish_hour"]


def cross_fitted_categories(df: DataFrame, folds: int = FOLDS, kind: str = "naive_bayes", key: str = "video_id",
                            **size) -> DataFrame:
    """(key, nlp_predicted_category, nlp_category_confidence) from a text model per fold.

    Vocabulary, weights and classifier of a fold come from the known categories of the other folds.  The class is the
    smallest category among the largest probabilities, all at nine digits.
    Rows without enough text get -1 and 0.  The folds are fitted side by side.
    """
    rows = combine_text(df.select(key, "title", "description", "tags", "category_id"))
    rows = rows.select(key, "category_id", "tokens", terms(F.col("tokens")).alias("terms"))
    rows = materialise(with_folds(rows, key, folds), "cross-fit-texts")
    known = rows.where(F.col("category_id").isin(*K.CATEGORY_TITLES) & has_text(F.col("tokens")))
    vocabulary = fold_vocabularies(known, folds)
    # At most fifteen rows per fold.
    counted = known.groupBy("fold", "category_id").agg(F.count("*").alias("n")).collect()

    def scores(fold):
        train = known.where(F.col("fold") != fold)
        sizes = {}
        for r in counted:
            if r["fold"] != fold:
                sizes[r["category_id"]] = sizes.get(r["category_id"], 0) + r["n"]
        if sum(sizes.values()) < K.MIN_TRAINING_ROWS * (folds - 1) / folds:
            raise ValueError(f"Insufficient training data: {sum(sizes.values())} samples")
        classes = F.array(*(F.lit(c) for c in sorted(sizes)))  # at most fifteen
        labelled = train.withColumn("label", (F.array_position(classes, F.col("category_id")) - 1).cast("int"))
        model = PipelineModel(nlp.fit_stages(labelled, nlp.classifier(kind, sum(sizes.values()), **size), vocabulary(fold)))
        scored = model.transform(rows.where(F.col("fold") == fold))
        chances = F.transform(nlp.class_probabilities(scored), lambda p: F.round(p, 9))
        best = F.array_max("chances")
        scored = scored.withColumn("chances", chances)
        usable = has_text(F.col("tokens"))
        return scored.select(
            key, F.when(usable, F.get(classes, F.array_position("chances", best) - 1)).otherwise(-1).alias("nlp_predicted_category"),
            F.when(usable, best).otherwise(0.0).alias("nlp_category_confidence"))

    return reduce(DataFrame.unionByName, side_by_side([partial(scores, k) for k in range(folds)], folds))


def _moments(rows: DataFrame, names: list[str]) -> tuple[list[str], dict[str, Column]]:
    """The columns that vary, and every column centred and scaled, which keeps the sums of products well conditioned."""
    row = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    varying = [c for c in names if row[f"s_{c}"]]
    scaled = {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"]) for c in varying}
    return varying, {**scaled, **{c: F.col(c) - F.lit(row[f"m_{c}"]) for c in names if c not in varying and row[f"m_{c}"] is not None}}


def cross_fitted_least_squares(rows: DataFrame, features: list[str], targets: list[str], folds: int = FOLDS,
                               key: str = "video_id") -> DataFrame:
    """(key, one column per target): ordinary least squares with an intercept, fitted on the other folds.

    One pass finds means and spreads, one the sums of products per fold; taking a fold's sums
    from the total leaves the sums of its training side, so any number of folds costs these two passes.
    At most ``folds`` rows of (features + targets) squared numbers come to the driver.
    """
    rows = with_folds(rows.select(key, *features, *targets), key, folds)
    varying, scaled = _moments(rows, [*features, *targets])
    used = [c for c in features if c in varying]
    columns = [F.lit(1.0), *(scaled[c] for c in used), *(F.col(t).cast("double") for t in targets)]
    n, width = 1 + len(used), len(columns)
    products = [F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, width)]
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(*products).collect()}
    gram = np.zeros((folds, n, width))
    for fold, r in sums.items():
        for i in range(n):
            for j in range(i, width):
                gram[fold, i, j] = r[f"g{i}_{j}"] or 0.0
                if j < n:
                    gram[fold, j, i] = gram[fold, i, j]
    total = gram.sum(axis=0)
    if total[0, 0] < K.MIN_TRAINING_ROWS:
        raise ValueError(f"Insufficient training data: {int(total[0, 0])} samples")
    solved = [np.linalg.lstsq((total - gram[k])[:, :n], (total - gram[k])[:, n:], rcond=None)[0] for k in range(folds)]

    def weight(place: int, target: int) -> Column:
        return F.get(F.array(*(F.lit(float(s[place, target])) for s in solved)), F.col("fold"))

    return rows.select(key, *(reduce(Column.__add__, (weight(i, t) * c for i, c in enumerate(columns[:n]))).alias(name)
                              for t, name in enumerate(targets)))


def cross_fitted_engagement(df: DataFrame, features: list[str] = LINEAR_FEATURES, folds: int = FOLDS,
                            key: str = "video_id") -> DataFrame:
    """(key, ml_predicted_views, ml_predicted_engagement_rate) of rows with views, as ``predict_engagement`` gives them.

    Views are learnt on a log scale and given as whole numbers, rates with nine digits; neither is below 0.
    """
    views = F.col("views").cast("double")
    rows = df.where(views > 0).select(
        key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features),
        F.log1p(views).alias("log_views"), F.coalesce(F.col("engagement_rate").cast("double"), F.lit(0.0)).alias("rate"))
    scored = cross_fitted_least_squares(rows, features, ["log_views", "rate"], folds, key)
    return scored.select(key, F.round(F.greatest(F.expm1("log_views"), F.lit(0.0))).alias("ml_predicted_views"),
                         F.round(F.greatest(F.col("rate"), F.lit(0.0)), 9).alias("ml_predicted_engagement_rate"))


def cross_fitted_predictions(df: DataFrame, folds: int = FOLDS, key: str = "video_id") -> DataFrame:
    """All prediction columns by key, each row scored by models that did not see it.  ``key`` is unique in ``df``.

    What the models read is written once, dealt over all tasks: texts cost more a row than their bytes tell.
    """
    read = [key, "title", "description", "tags", "category_id", "views", "engagement_rate"]
    rows = df.select(*dict.fromkeys([*read, *LINEAR_FEATURES]))
    rows = materialise(spread(rows, key), "cross-fit-rows")
    return cross_fitted_categories(rows, folds, key=key).join(cross_fitted_engagement(rows, folds=folds, key=key), key, "left")
