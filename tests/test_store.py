"""Models that are fitted once."""

import pytest
from pyspark.sql import functions as F

from trendmill.models import engagement, store


def views(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("v"), i).alias("video_id"), (i % 30).alias("tag_count"), (i % 7).alias("publish_hour"),
        (F.exp((i % 30) / 3.0) * 100).cast("long").alias("views"), (i % 7 / 100.0).alias("engagement_rate"))


def test_fingerprint_follows_the_rows_not_their_order(spark):
    df = views(spark)
    assert store.fingerprint(df) == store.fingerprint(df.repartition(5).select(*reversed(df.columns)))
    assert store.fingerprint(df) != store.fingerprint(df.unionByName(df.limit(1)))
    assert store.fingerprint(df) != store.fingerprint(df.withColumn("views", F.col("views") + F.when(
        F.col("video_id") == "v9", 1).otherwise(0)))
    assert store.fingerprint(df.limit(0)) == store.fingerprint(df.limit(0))


def test_a_model_is_fitted_once_per_rows_and_parameters(spark, monkeypatch):
    rows, names = engagement.training_set(views(spark))
    fits, fit = [], engagement.fit_and_score

    def counted(*args):
        fits.append(args)
        return fit(*args)

    monkeypatch.setattr(engagement, "fit_and_score", counted)
    first = engagement.fit_once(rows, names, "views", engagement.random_forest(3, 4), 2)
    second = engagement.fit_once(rows.repartition(3), names, "views", engagement.random_forest(3, 4), 2)
    assert len(fits) == 1 and first.metrics == second.metrics and {"cv_mean_r2", "test_r2"} <= set(second.metrics)
    scored = [m.pipeline.transform(rows).select("video_id", "prediction") for m in (first, second)]
    assert scored[0].exceptAll(scored[1]).count() == 0
    engagement.fit_once(rows, names, "views", engagement.random_forest(4, 4), 2)
    engagement.fit_once(rows.where("video_id <> 'v3'"), names, "views", engagement.random_forest(3, 4), 2)
    engagement.fit_once(rows, names, "engagement_rate", engagement.random_forest(3, 4), 2)
    assert len(fits) == 4


def test_a_fit_cut_short_leaves_nothing(spark):
    rows, _ = engagement.training_set(views(spark))
    with pytest.raises(RuntimeError):
        store.fitted_once(rows, "short", {}, lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    done = []

    def fit():
        done.append(1)
        model = engagement.fit_and_score(rows, ["tag_count"], "views", engagement.random_forest(2, 2), 0)
        return model.pipeline, model.metrics

    assert store.fitted_once(rows, "short", {}, fit)[1] == store.fitted_once(rows, "short", {}, fit)[1]
    assert len(done) == 1
