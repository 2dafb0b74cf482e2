"""Fits get the tasks their rows fill, and only the whole fit's model stays."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from trendmill.models import age, engagement, store


def rows(spark, n=400):
    i = F.col("id")
    return engagement.training_set(spark.range(n).select(
        F.concat(F.lit("v"), i).alias("video_id"), (i % 30).alias("tag_count"), (i % 7).alias("publish_hour"),
        (F.exp((i % 30) / 3.0) * 100).cast("long").alias("views"), (i % 7 / 100.0).alias("engagement_rate")))


def test_small_training_rows_are_not_dealt_over_many_tasks(spark, monkeypatch):
    tasks, fit = [], Pipeline.fit

    def recorded(self, dataset, params=None):
        tasks.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(Pipeline, "fit", recorded)
    data, names = rows(spark)
    fitted = engagement.fit_and_score(data.repartition(8), names, "views", engagement.random_forest(2, 3), 3)
    assert tasks == [1] * 4 and {"cv_mean_r2", "cv_std_r2", "test_r2"} <= set(fitted.metrics)


def test_tasks_grow_with_the_rows():
    assert [store.train_tasks(n, 100) for n in (0, 100, 101, 1000)] == [1, 1, 2, 10]


def test_side_by_side_keeps_the_order_of_the_fits():
    assert store.fit_side_by_side([lambda k=k: k * k for k in range(9)], 3) == [k * k for k in range(9)]


def test_forests_keep_the_nodes_of_their_rows():
    assert engagement.random_forest().getCacheNodeIds() and age.classifier("random_forest").getCacheNodeIds()
