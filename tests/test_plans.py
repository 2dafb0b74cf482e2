"""The plans are the ones meant: pruned scans, map-side combining, no hidden cross joins."""

import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from trendmill.operators.filters import apply_dashboard_filters
from trendmill.sources import sinks


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_partitions_and_scan(spark, tmp_path):
    df = spark.range(100).select(
        F.col("id").alias("views"), (F.col("id") % 3).cast("int").alias("category_id"),
        F.when(F.col("id") % 2 == 0, "US").otherwise("GB").alias("region_code"), F.lit("x").alias("title"))
    table = sinks.write_partitioned_parquet(df, str(tmp_path / "t"))
    chosen = apply_dashboard_filters(table, regions=["US"], categories=[1], views=(10, None)).select("views")
    plan = physical(chosen)
    partition = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "region_code" in partition and "category_id" in partition
    assert "GreaterThanOrEqual(views,10)" in plan
    assert "title" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_views_read_only_their_columns(spark, data):
    plan = physical(queries()["viral_content_analysis"](spark, data))
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert not any("l_" in s for s in schemas), "likes are not needed, so lines are not read"


def test_last_row_of_a_key_combines_before_the_shuffle(spark, data):
    plan = physical(queries()["dedup_keep_last"](spark, data))
    assert "partial_max" in plan and "Window" not in plan


def test_no_catalogue_view_multiplies_rows(spark, data):
    for name in ("lod_fixed_metrics", "engagement_box_by_tags", "category_name_lookup", "auc_rank", "stratified_split"):
        plan = physical(queries()[name](spark, data))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
