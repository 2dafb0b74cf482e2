"""Readers on files as others write them."""

import json

import pytest

from trendmill.operators.joins import category_dimension
from trendmill.schema import JOB_INPUT
from trendmill.sources import files, sinks


def test_category_document_over_several_lines(spark, tmp_path):
    (tmp_path / "US_category_id.json").write_text(json.dumps({"kind": "list", "items": [
        {"id": "1", "snippet": {"title": "Film", "assignable": True, "channelId": "UC"}},
        {"id": "2", "snippet": {"title": None}}, {"snippet": {"title": "No id"}}]}, indent=2))
    got = files.load_category_reference(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("1", "Film")]
    flat = files.json_items_to_rows(spark, str(tmp_path))
    assert set(flat.columns) == {"id", "snippet.title", "snippet.assignable", "snippet.channelId"}
    assert flat.count() == 3


def test_regional_csv(spark, tmp_path):
    head = "video_id,title,channel_title,category_id,publish_time,tags,views,likes,dislikes,comment_count,thumbnail_link,description\n"
    (tmp_path / "USvideos.csv").write_text(head + 'a,"Say ""hi""",C,10,2023-01-01T10:00:00.000Z,x|y,100,5,0,5,u,"two\nlines"\n')
    (tmp_path / "ZZvideos.csv").write_text(head + "b,T,C,10,2023-01-01T10:00:00.000Z,x,1,1,0,1,u,d\n")
    rows = files.load_all_regions(spark, str(tmp_path)).collect()
    assert [(r.video_id, r.title, r.description, r.region_code) for r in rows] == [("a", 'Say "hi"', "two\nlines", "US")]
    assert {r[0] for r in files.missing_regions(spark, str(tmp_path)).collect()} == {
        "GB", "CA", "DE", "FR", "IN", "JP", "KR", "MX", "RU"}
    with pytest.raises(ValueError):
        files.load_region_csv(spark, str(tmp_path), "ZZ")


HEAD = "video_id,title,channel_title,category_id,publish_time,tags,views,likes,dislikes,comment_count,thumbnail_link,description"


def test_regions_that_cannot_be_read_are_set_aside(spark, tmp_path):
    """One region each: in order, by another order of columns, broken records, no needed column, damaged, header only."""
    land = tmp_path / "land"
    land.mkdir()
    names = HEAD.split(",")
    line = dict(zip(names, ["a", '"x, y"', "C", "10", "t", "", "100", "5", "0", "5", "u", '"two\nlines"']))
    plain = ",".join(line.values())
    (land / "USvideos.csv").write_text(f"{HEAD}\n{plain}\n{plain}\n")
    (land / "GBvideos.csv").write_text("extra," + ",".join(reversed(names)) + "\ne," + ",".join(line[n] for n in reversed(names)) + "\n")
    (land / "INvideos.csv").write_text(f"{HEAD}\n{plain}\na,too,few\n{plain},too many\n{plain}\n")
    (land / "FRvideos.csv").write_text(HEAD.replace(",views", "") + "\n" + plain + "\n")
    (land / "DEvideos.csv.gz").write_bytes(b"\x1f\x8b no archive at all")
    (land / "DEvideos.csv").mkdir()
    (land / "DEvideos.csv.gz").rename(land / "DEvideos.csv" / "part.csv.gz")
    (land / "JPvideos.csv").write_text(HEAD + "\n")
    (land / "ZZvideos.csv").write_text(f"{HEAD}\n{plain}\n")
    done = files.load_regions(spark, str(land), str(tmp_path / "out"))
    report = {r.region_code: r for r in done.report.collect()}
    assert {k: (r.status, r.rows, r.broken_rows) for k, r in report.items()} == {
        "US": ("loaded", 2, 0), "GB": ("loaded", 1, 0), "IN": ("loaded", 2, 2), "FR": ("rejected", 0, 0),
        "DE": ("rejected", 0, 0), "JP": ("loaded", 0, 0)}
    assert report["FR"].reason == "columns missing: views" and report["DE"].reason and report["US"].reason is None
    rows = done.rows.collect()
    assert sorted(r.region_code for r in rows) == ["GB", "IN", "IN", "US", "US"]
    assert {(r.video_id, r.title, r.tags, r.views, r.description) for r in rows} == {("a", "x, y", None, "100", "two\nlines")}
    assert sorted(r.record.rstrip("\n") for r in done.broken.collect()) == sorted(["a,too,few", f"{plain},too many"])
    by_name = files.load_region_csv(spark, str(land), "GB").first()
    assert (by_name.title, by_name.views, by_name.region_code) == ("x, y", "100", "GB")
    with pytest.raises(ValueError):
        files.load_region_csv(spark, str(land), "FR")
    none = files.load_regions(spark, str(tmp_path / "out" / "region=US"), str(tmp_path / "none"))
    assert none.rows.count() == none.report.count() == none.broken.count() == 0


def test_formats(spark, tmp_path):
    row = dict.fromkeys(JOB_INPUT.names, "x") | {"views": "12", "likes": "bad", "publish_date": "2023-01-01"}
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in JOB_INPUT.names))
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        df.write.option("header", True).format(fmt).save(path)
        got = files.load_any_format(spark, path).first()
        assert (got.views, got.likes, got.title) == (12, None, "x")
    df.select("video_id").write.parquet(str(tmp_path / "narrow"))
    with pytest.raises(ValueError):
        files.load_any_format(spark, str(tmp_path / "narrow"))
    with pytest.raises(ValueError):
        files.load_by_extension(spark, "table.orc")


def test_only_the_days_at_hand_are_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "US", 1), ("b", "GB", 1)], "video_id string, region_code string, category_id int")
    sinks.write_partitioned_parquet(first, path)
    again = spark.createDataFrame([("c", "US", 1)], first.schema)
    assert {r.video_id for r in sinks.write_partitioned_parquet(again, path).collect()} == {"b", "c"}


def test_dimension_is_small_enough_for_a_broadcast_by_size(spark):
    plan = spark.range(10).selectExpr("cast(id as int) category_id").join(
        category_dimension(spark), "category_id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
