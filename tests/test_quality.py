"""The validator on a table with injected faults."""

import pytest
from pyspark.sql import functions as F

from trendmill import schema as zones
from trendmill.operators import quality


def faulty(spark):
    """1000 rows: 11 negative views, 11 bad categories, 6 repeated ids, 6 blank titles, 6 unknown regions."""
    i = F.col("id")
    return spark.range(1000).select(
        F.when((i >= 100) & (i < 106), F.lit("video_99")).otherwise(F.concat(F.lit("video_"), i)).alias("video_id"),
        F.when((i >= 200) & (i < 206), F.lit("")).otherwise(F.concat(F.lit("Title "), i)).alias("title"),
        F.lit("text").alias("description"), F.concat(F.lit("Channel "), i % 20).alias("channel_title"),
        F.when(i < 11, F.lit(-5)).otherwise(i * 100 + 2000).cast("long").alias("views"),
        (i + 50).alias("likes"), (i % 40).alias("comments"),
        F.when((i >= 300) & (i < 311), F.lit(50)).otherwise(i % 44 + 1).cast("int").alias("category_id"),
        F.when((i >= 400) & (i < 406), F.lit("XX")).otherwise(F.lit("US")).alias("region_code"),
        F.lit(0.02).alias("engagement_rate"))


def test_faults_are_counted(spark):
    results = quality.run_suite(faulty(spark), quality.TABLE_RULES).collect()
    found = {(r.expectation, r.column): r.unexpected_count for r in results if not r.success}
    assert found == {
        ("unique", "video_id"): 6, ("between", "category_id"): 11, ("between", "views"): 11,
        ("length", "title"): 6, ("in_set", "region_code"): 6, ("row_count", None): 0,
        ("pair_not_before", "trending_date,publish_date"): 1000}
    assert [r.id for r in sorted(results, key=lambda r: r.id)] == list(range(len(quality.TABLE_RULES)))


def test_score_and_status(spark):
    results = quality.run_suite(faulty(spark), quality.TABLE_RULES)
    score = quality.quality_status(quality.quality_score(results)).first()
    assert score.total_expectations == len(quality.TABLE_RULES) and score.failed_expectations == 7
    assert score.quality_score == pytest.approx(79.41) and score.status == "failure" and not score.passed


def test_the_suite_has_38_expectations_of_18_kinds(spark):
    assert len(quality.SUITE) == 38
    # The boolean check is one of the type checks here.
    assert len({kind for kind, _ in quality.SUITE}) == 17


def test_row_violations_and_report_agree(spark):
    df = faulty(spark)
    rows = quality.row_violations(df, zones.RAW).select(F.explode("violations").alias("v")).groupBy("v").count()
    report = quality.violation_report(df, zones.RAW)
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in report.collect()}
    assert {r[0] for r in report.collect()} == {"title:min_length", "category_id:max", "views:min"}


def test_schema_round_trip(tmp_path):
    for name, schema in zones.SCHEMAS.items():
        path = str(tmp_path / f"{name}.json")
        zones.save_schema(name, path)
        assert zones.load_schema(path) == schema
        assert zones.load_schema(path)["views"].metadata == schema["views"].metadata
    assert [len(zones.schema(n).fields) for n in ("raw", "cleaned", "analytics", "job_input")] == [15, 25, 34, 21]


def plain_keys(rows, rule, kw):
    """(success, observed, unexpected) of a distinct or compound check over a list of dicts."""
    if rule == "compound_unique":
        keys = [tuple(r[c] for c in kw["columns"]) for r in rows]
        repeated = {k for k in keys if keys.count(k) > 1}
        n = sum(k in repeated for k in keys)
        return n == 0, len(repeated), n
    values = [r[kw["column"]] for r in rows if r[kw["column"]] is not None]
    if rule == "unique":
        return len(values) == len(set(values)), len(set(values)), len(values) - len(set(values))
    share = len(set(values)) / len(values) if values else None
    return share is not None and share >= kw["min"], share, 0


KEY_RULES = [("unique", {"column": "id"}), ("compound_unique", {"columns": ["id", "part"]}),
             ("unique_proportion", {"column": "value", "min": 0.5}), ("unique", {"column": "id"}),
             ("compound_unique", {"columns": ["part", "id"]}), ("unique", {"column": "part"}),
             ("compound_unique", {"columns": ["value"]}), ("unique_proportion", {"column": "none", "min": 0.1})]


def test_distinct_and_compound_checks_equal_plain_python(spark):
    data = [dict(id=i % 40 if i % 9 else None, part="ab"[i % 2] if i % 7 else None, value=[0.5, 2.0, None, float(i)][i % 4],
                 none=None, n=i) for i in range(120)] + [dict(id=1, part="a", value=2.0, none=None, n=-1)] * 60
    df = spark.createDataFrame(data, "id int, part string, value double, none string, n int")
    for rows, frame in ((data, df), ([], df.limit(0))):
        got = {r.id: (r.success, r.observed, r.unexpected_count) for r in quality.run_suite(frame, KEY_RULES).collect()}
        assert got == {i: plain_keys(rows, *rule) for i, rule in enumerate(KEY_RULES)}
    got = {(r.part, r.id): (r.success, r.observed, r.unexpected_count)
           for r in quality.run_suite(df, [r for r in KEY_RULES if r[1].get("column") != "part"], by=["part"]).collect()}
    rules = [r for r in KEY_RULES if r[1].get("column") != "part"]
    assert got == {(p, i): plain_keys([r for r in data if r["part"] == p], *rule)
                   for p in ("a", "b", None) for i, rule in enumerate(rules)}


def test_distinct_and_compound_checks_share_one_exchange_of_keys(spark):
    plan = quality.run_suite(faulty(spark), [
        ("unique", {"column": "video_id"}), ("unique_proportion", {"column": "title", "min": 0.1}),
        ("compound_unique", {"columns": ["video_id", "region_code"]})])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 2 and plan.count("Range (") == 1
