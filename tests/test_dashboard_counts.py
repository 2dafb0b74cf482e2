"""The dashboard's distinct counts of videos."""

from trendmill.operators import views

SCHEMA = ("video_id string, views long, likes long, comments long, engagement_rate double, category_id int, channel_title string, "
          "region_code string, publish_date timestamp_ntz, trending_date timestamp_ntz, view_category string, "
          "engagement_category string, nlp_predicted_category int, ml_predicted_views double")


def test_videos_are_counted_once_and_shipped_once(spark):
    def row(video, category, predicted, views=100):
        return (video, views, 1, 1, 0.02, category, "c", "US", None, None, "Low", "Medium", predicted, 90.0)

    df = spark.createDataFrame([row("a", 1, 1), row("a", 1, 2), row("b", 1, None), row("b", 2, 1), row("c", None, None),
                                row(None, 1, 1), row("d", 1, 1, 0), row("e", None, 3)], SCHEMA)
    found = views.dashboard_summary(df, as_of="2024-01-01")
    r = found.first()
    assert (r.total_videos, r.unique_videos, r.correct_nlp_predictions, r.total_nlp_predictions) == (7, 4, 1, 3)
    assert (r.unique_categories, r.unique_channels, r.avg_ml_error_rate) == (2, 1, 0.1)
    assert found.columns[:2] == ["total_videos", "unique_videos"] and found.columns[-1] == "days_since_last_trending"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Expand" in line and "video_id" in line]
    assert views.dashboard_summary(df.limit(0)).first().unique_videos == 0
