"""Tables stay readable while they are replaced, and keep their rows if a writer dies."""

import uuid

import pytest
from pyspark.sql import functions as F

from trendmill.sources import sinks, versions


def rows(spark, n, title="t"):
    i = F.col("id")
    return spark.range(n).select(i.cast("string").alias("video_id"), F.lit(title).alias("title"),
                                 F.when(i % 3 == 0, "US").otherwise("GB").alias("region_code"), (i % 2).cast("int").alias("category_id"))


def dying(spark, n):
    """Fails on its last row, after others were written."""
    return rows(spark, n).withColumn("title", F.when(F.col("video_id") == str(n - 1), F.raise_error(F.lit("lost"))).otherwise("new"))


@pytest.fixture
def name(spark):
    table = "t_" + uuid.uuid4().hex[:8]
    yield table
    spark.sql(f"DROP VIEW IF EXISTS {table}")


def test_readers_between_two_versions(spark, tmp_path, name):
    root = str(tmp_path / "d")
    first = sinks.publish_partitioned(rows(spark, 30, "old"), root, name)
    reader = spark.table(name)
    assert reader.where("region_code = 'US'").count() == 10 and first.columns == ["video_id", "title", "region_code", "category_id"]
    sinks.publish_partitioned(rows(spark, 12, "new"), root, name)
    assert {(r.title, r["count"]) for r in reader.groupBy("title").count().collect()} == {("old", 30)}
    assert {(r.title, r["count"]) for r in spark.table(name).groupBy("title").count().collect()} == {("new", 12)}
    plan = spark.table(name).where("region_code = 'US'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region_code" in plan


def test_writer_that_dies_leaves_the_old_rows(spark, tmp_path, name):
    root = str(tmp_path / "d")
    sinks.publish_partitioned(rows(spark, 30, "old"), root, name)
    with pytest.raises(Exception, match="lost"):
        sinks.publish_partitioned(dying(spark, 40), root, name)
    assert spark.table(name).where("title = 'old'").count() == spark.table(name).count() == 30
    # What the dead writer left neither counts nor stands in the way.
    (tmp_path / "d" / "v=7").mkdir()
    assert versions.complete_numbers(spark, root) == [1]
    sinks.publish_partitioned(rows(spark, 5, "new"), root, name)
    assert versions.complete_numbers(spark, root) == [1, 8] and spark.table(name).count() == 5


def test_append_and_overwrite_of_a_dataset_by_itself(spark, tmp_path, name):
    root, data = str(tmp_path / "d"), rows(spark, 10)
    assert versions.read_version(spark, root, data.schema).count() == 0
    for n in (10, 20):
        assert sinks.append_or_overwrite_dataset(data, root, "append", name).count() == n
    with pytest.raises(Exception, match="lost"):
        sinks.append_or_overwrite_dataset(dying(spark, 9), root, "append", name)
    assert spark.table(name).count() == 20
    kept = versions.read_version(spark, root, data.schema).where("video_id < '5'").distinct()
    assert sinks.append_or_overwrite_dataset(kept, root, "overwrite", name).count() == 5
    assert versions.read_version(spark, root, data.schema).count() == spark.table(name).count() == 5
    with pytest.raises(ValueError):
        sinks.append_or_overwrite_dataset(data, root, "merge")


def test_empty_and_odd_tables(spark, tmp_path, name):
    empty = sinks.publish_partitioned(rows(spark, 0), str(tmp_path / "e"), name)
    assert empty.count() == 0 and empty.schema.simpleString() == rows(spark, 0).schema.simpleString()
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "x", "k")], "`a b` int, `c``d` string, key string")
    out = versions.publish_table(odd, str(tmp_path / "o"), name, ["key"])
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
