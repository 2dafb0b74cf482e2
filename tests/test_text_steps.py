"""Texts are read once, by all tasks, and counted once for all folds."""

from pyspark.sql import functions as F

from trendmill.models import crossfit, nlp, text
from trendmill.models.split import with_folds

WORDS = "pasta recipe kitchen sauce gaming console battle victory music guitar".split()


def videos(spark, n=300):
    i = F.col("id")
    pick = F.array(*(F.lit(w) for w in WORDS))
    words = F.concat_ws(" ", F.get(pick, (i % 10).cast("int")), F.get(pick, (i * 7 % 9).cast("int")), F.get(pick, (i * i % 8).cast("int")))
    return spark.range(0, n, 1, 1).select(
        F.concat(F.lit("v"), i).alias("video_id"), words.alias("title"), words.alias("description"), F.lit("x|y").alias("tags"),
        F.when(i % 2 == 0, 26).otherwise(20).alias("category_id"), (i % 9).alias("likes"), (i % 5).alias("comments"),
        (i % 7).alias("title_length"), (i % 24).alias("publish_hour"), (100 + i).alias("views"), (i % 17 / 100.0).alias("engagement_rate"))


def test_fold_vocabularies_equal_those_counted_apart(spark):
    rows = text.combine_text(videos(spark)).withColumn("terms", text.terms(F.col("tokens")))
    rows = with_folds(rows, "video_id", 3)
    by_fold = text.fold_vocabularies(rows, 3, max_terms=12, min_df=30, max_df=0.4)
    for fold in (None, 0, 1, 2):
        part = rows if fold is None else rows.where(F.col("fold") != fold)
        want = text.vocabulary(part, max_terms=12, min_df=30, max_df=0.4).collect()
        assert want and sorted(by_fold(fold).collect()) == sorted(want)


def files(frame):
    return frame.select(F.input_file_name()).distinct().count()


def test_tokens_are_read_off_by_all_tasks(spark):
    rows = nlp.known_tokens(videos(spark))  # one partition, as a table in one file is
    assert files(rows) == 4 and not {"title", "description", "tags"} & set(rows.columns)
    assert rows.count() == 300


def test_cross_fitted_rows_are_dealt_over_all_tasks(spark, monkeypatch):
    kept = {}
    keep = crossfit.materialise
    monkeypatch.setattr(crossfit, "materialise", lambda df, name="stage": kept.setdefault(name, keep(df, name)))
    crossfit.cross_fitted_predictions(videos(spark), folds=2)
    assert files(kept["cross-fit-rows"]) == 4
