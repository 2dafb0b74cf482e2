"""The catalogue next to its SQL twins, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import compare, connect

# A spread over every module; tools/check_oracle.py runs them all.
SAMPLE = [
    "category_analysis", "dashboard_summary", "trending_analysis", "ml_predictions_analysis", "age_labels",
    "tag_metrics", "content_themes", "dedup_keep_last", "cap_outliers_iqr", "glue_clean",
    "apply_dashboard_filters", "top_channels", "error_histogram", "lod_fixed_metrics", "age_insights",
    "classification_report", "auc_rank", "run_suite", "expect_increasing", "flatten_video_documents",
    "load_all_regions", "read_latest_batch", "tfidf_vectors", "stratified_split", "stream_daily_views",
]


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, data, duck, name):
    problem, rows = compare(queries()[name](spark, data), duck, oracle_sql()[name])
    assert problem is None and rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
