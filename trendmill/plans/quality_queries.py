"""D*: data quality.  SQL twins are generated from the same rule lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import schema as zones
from trendmill.adapters import TRENDING_ORDER, event_videos, table, trending, videos
from trendmill.operators import clean, quality
from trendmill.operators.ordering import order_breaks
from trendmill.operators.ranks import exact_quantiles
from trendmill.plans.registry import query
from trendmill.plans.sqltext import (
    enriched_sql, in_list, q, videos_sql, with_tables,
)
from trendmill.plans.tables import enriched

_COLUMNS = ["video_id", "title", "description", "tags", "category_id", "channel_title", "publish_date",
            "trending_date", "region_code", "views", "likes", "comments", "engagement_rate", "title_length",
            "description_length", "tag_count", "title_word_count", "has_description", "has_tags",
            "engagement_category", "view_category", "extracted_at", "seq"]


def checked(spark, sf):
    """What the suite looks at: the suite's columns, extraction time and the row order."""
    return enriched(spark, sf).select(*_COLUMNS)


# Types of the table above, for the SQL side of the type checks.
_NUMBERS = {"views", "likes", "comments", "category_id", "title_length", "description_length", "tag_count",
            "title_word_count"}
_BOOLEANS = {"has_description", "has_tags"}
_TIMES = {"publish_date", "trending_date", "extracted_at"}


def _type_ok(column: str, kind: str) -> bool:
    return column in {"int64": _NUMBERS, "bool": _BOOLEANS, "datetime64[ns]": _TIMES}.get(
        kind, set(_COLUMNS) - _NUMBERS - _BOOLEANS - _TIMES - {"engagement_rate"})


def _bad(kind: str, kw: dict) -> str | None:
    c = kw.get("column")
    return {
        "not_null": lambda: f"{c} IS NULL",
        "in_set": lambda: f"{c} NOT IN {in_list(kw['values'])}",
        "between": lambda: f"({c} < {kw['min']} OR {c} > {kw['max']})",
        "length": lambda: f"(length({c}) < {kw['min']} OR length({c}) > {kw['max']})",
        "match": lambda: f"NOT regexp_matches({c}, {q(kw['pattern'])})",
        "not_match": lambda: f"regexp_matches({c}, {q(kw['pattern'])})",
        "pair_greater": lambda: f"{kw['a']} <= {kw['b']}",
        "pair_mostly_not_less": lambda: f"{kw['a']} < {kw['b']}",
        "pair_not_before": lambda: f"{kw['a']} < {kw['b']}",
    }.get(kind, lambda: None)()


def _span(value: str, kw: dict) -> str:
    tests = [f"{value} IS NOT NULL"]
    if "min" in kw:
        tests.append(f"{value} >= {kw['min']}")
    if "max" in kw:
        tests.append(f"{value} <= {kw['max']}")
    return " AND ".join(tests)


def _row(i: int, kind: str, kw: dict, source: str) -> str:
    """SELECT giving (id, expectation, success, unexpected_count) for one expectation."""
    head = f"SELECT {i} AS id, {q(kind)} AS expectation, "
    c = kw.get("column")
    if kind == "exists":
        ok = c in _COLUMNS
    elif kind == "type":
        ok = _type_ok(c, kw["type"])
    elif kind == "columns_ordered":
        ok = _COLUMNS[:-1] == kw["columns"]
    else:
        ok = None
    if ok is not None:
        return head + f"{str(ok).lower()} AS success, {0 if ok else 1} AS unexpected_count"
    bad = _bad(kind, kw)
    if bad:
        verdict = f"n * 1.0 / total <= {kw['tolerance']}" if kind == "pair_mostly_not_less" else "n = 0"
        return head + (f"{verdict} AS success, n AS unexpected_count "
                       f"FROM (SELECT count(*) FILTER ({bad}) AS n, count(*) AS total FROM {source})")
    measure = {"row_count": "count(*)", "mean": f"avg({c})", "stdev": f"stddev_samp({c})",
               "median": f"median({c})", "unique_proportion": f"count(DISTINCT {c}) * 1.0 / count({c})"}.get(kind)
    if measure:
        return head + f"{_span('m', kw)} AS success, 0 AS unexpected_count FROM (SELECT {measure} AS m FROM {source})"
    if kind == "unique":
        return head + (f"n = 0 AS success, n AS unexpected_count "
                       f"FROM (SELECT count({c}) - count(DISTINCT {c}) AS n FROM {source})")
    if kind == "compound_unique":
        return head + (f"count(*) = 0 AS success, coalesce(CAST(sum(n) AS BIGINT), 0) AS unexpected_count FROM ("
                       f"SELECT count(*) AS n FROM {source} GROUP BY {', '.join(kw['columns'])} HAVING count(*) > 1)")
    if kind == "increasing":
        return head + (f"count(*) = 0 AS success, count(*) AS unexpected_count FROM (SELECT {c}, "
                       f"lag({c}) OVER (ORDER BY seq) AS before FROM {source} WHERE {c} IS NOT NULL) WHERE {c} < before")
    raise ValueError(kind)


def suite_sql(suite, source: str = "enriched") -> str:
    rows = "\nUNION ALL ".join(_row(i, kind, kw, source) for i, (kind, kw) in enumerate(suite))
    return f"SELECT CAST(id AS INTEGER) AS id, expectation, success, CAST(unexpected_count AS BIGINT) AS unexpected_count FROM ({rows})"


_RESULT = ["id", "expectation", "success", "unexpected_count"]


@query("run_suite", enriched_sql(suite_sql(quality.SUITE)))
def run_suite(spark, sf):
    return quality.run_suite(checked(spark, sf), quality.SUITE, order="seq").select(*_RESULT)


@query("table_rules", enriched_sql(suite_sql(quality.TABLE_RULES)))
def table_rules(spark, sf):
    """The code-level validator's rules."""
    return quality.run_suite(checked(spark, sf), quality.TABLE_RULES, order="seq").select(*_RESULT)


_SCORE = """count(*) AS total_expectations, count(*) FILTER (success) AS successful_expectations,
  count(*) FILTER (NOT success) AS failed_expectations,
  round(count(*) FILTER (success) * 100.0 / count(*), 2) AS quality_score,
  round(count(*) FILTER (success) * 100.0 / count(*), 2) >= 90 AS passed"""


@query("quality_score", enriched_sql(f"SELECT {_SCORE} FROM ({suite_sql(quality.SUITE)})"),
       doubles="quality_score:2")
def quality_score(spark, sf):
    return quality.quality_score(quality.run_suite(checked(spark, sf), order="seq"))


@query("quality_status", enriched_sql(f"""
SELECT *, CASE WHEN quality_score >= 95 THEN 'success' WHEN quality_score >= 85 THEN 'warning'
  WHEN quality_score >= 70 THEN 'failure' ELSE 'critical' END AS status
FROM (SELECT {_SCORE} FROM ({suite_sql(quality.TABLE_RULES)}))"""), doubles="quality_score:2")
def quality_status(spark, sf):
    results = quality.run_suite(checked(spark, sf), quality.TABLE_RULES, order="seq")
    return quality.quality_status(quality.quality_score(results))


@query("failed_expectations", enriched_sql(f"SELECT * FROM ({suite_sql(quality.SUITE)}) WHERE NOT success"))
def failed_expectations(spark, sf):
    return quality.failed_expectations(quality.run_suite(checked(spark, sf), order="seq")).select(*_RESULT)


def _kind_query(name: str, kinds: tuple):
    """All expectations of some kinds, from the suite and the table rules."""
    rules = [s for s in quality.SUITE + quality.TABLE_RULES if s[0] in kinds]

    @query(name, enriched_sql(suite_sql(rules)))
    def run(spark, sf):
        return quality.run_suite(checked(spark, sf), rules, order="seq").select(*_RESULT)

    return run


_kind_query("expect_not_null", ("not_null",))
_kind_query("expect_unique", ("unique",))
_kind_query("expect_in_set", ("in_set",))
_kind_query("expect_between", ("between",))
_kind_query("expect_length_between", ("length",))
_kind_query("expect_match_regex", ("match", "not_match"))
_kind_query("expect_row_count_min", ("row_count",))
_kind_query("expect_mean_between", ("mean",))
_kind_query("expect_median_between", ("median",))
_kind_query("expect_stdev_between", ("stdev",))
_kind_query("expect_unique_proportion", ("unique_proportion",))
_kind_query("expect_pair_a_gt_b", ("pair_greater", "pair_mostly_not_less", "pair_not_before"))


@query("expect_compound_unique", with_tables("""
SELECT count(*) AS repeated_keys, coalesce(CAST(sum(n) AS BIGINT), 0) AS repeated_rows FROM (
  SELECT count(*) AS n FROM trending GROUP BY video_id, region_code, trending_date HAVING count(*) > 1)""", "trending"))
def expect_compound_unique(spark, sf):
    """Raw rows: one per video, region and day?"""
    return quality.compound_duplicates(trending(spark, sf), ["video_id", "region_code", "trending_date"])


@query("expect_increasing", videos_sql("""
SELECT count(*) AS checked, count(*) FILTER (trending_date < before) AS breaks
FROM (SELECT trending_date, lag(trending_date) OVER (ORDER BY seq) AS before FROM videos
  WHERE trending_date IS NOT NULL)"""))
def expect_increasing(spark, sf):
    return order_breaks(videos(spark, sf), "seq", F.col("trending_date"))


@query("increasing_check", """
SELECT count(*) AS checked, count(*) FILTER (value < before) AS breaks
FROM (SELECT value, lag(value) OVER (ORDER BY user_id, value) AS before FROM events)""")
def increasing_check(spark, sf):
    """A coarse order column with many ties: users as the order, values as the series."""
    return order_breaks(table(spark, sf, "events"), "user_id", F.col("value"), span=16)


def _rule_sql(fields, types: dict[str, str]) -> str:
    arms = []
    for field in fields:
        if field.name not in types:
            continue
        meta, c = field.metadata or {}, field.name
        tests = {"null": f"{c} IS NULL" if not field.nullable else None,
                 "min": f"{c} < {meta['min']}" if "min" in meta else None,
                 "max": f"{c} > {meta['max']}" if "max" in meta else None,
                 "min_length": f"length({c}) < {meta['min_length']}" if "min_length" in meta else None,
                 "max_length": f"length({c}) > {meta['max_length']}" if "max_length" in meta else None,
                 "pattern": f"NOT regexp_matches({c}, {q(meta['pattern'])})" if "pattern" in meta else None,
                 "allowed": f"{c} NOT IN {in_list(meta['allowed'])}" if "allowed" in meta else None}
        arms += [f"SELECT {q(f'{c}:{rule}')} AS violation, count(*) AS rows FROM enriched WHERE {test}"
                 for rule, test in tests.items() if test]
    return "SELECT * FROM (" + "\nUNION ALL ".join(arms) + ") WHERE rows > 0"


@query("validate_rows", enriched_sql(_rule_sql(zones.CLEANED.fields, dict.fromkeys(_COLUMNS, ""))))
def validate_rows(spark, sf):
    return quality.violation_report(checked(spark, sf), zones.CLEANED)


@query("validate_table_schema", videos_sql("""
SELECT * FROM (
  SELECT 'category_name' AS "column", 'missing' AS status, 0 AS filled_rows
  UNION ALL SELECT 'thumbnail_url', 'missing', 0
  UNION ALL SELECT 'channel_id', 'missing', 0
  UNION ALL SELECT 'seq', 'extra', count(seq) FROM videos)"""))
def validate_table_schema(spark, sf):
    issues = quality.table_schema_issues(checked(spark, sf), zones.CLEANED)
    return issues.where("status <> 'ok'").select("column", "status", "filled_rows")


@query("schema_drift_check", """
SELECT * FROM (
  SELECT 'doc_id' AS "column", 'extra' AS status, count(doc_id) AS filled_rows FROM documents
  UNION ALL SELECT 'text', 'extra', count(text) FROM documents
  UNION ALL SELECT 'lang', 'extra', count(lang) FROM documents
  UNION ALL SELECT 'n_chars', 'extra', count(n_chars) FROM documents
  UNION ALL SELECT 'source', 'type_mismatch', count(source) FROM documents)""")
def schema_drift_check(spark, sf):
    """Documents against a declaration that only knows ``source``, as a number."""
    from pyspark.sql import types as T
    declared = T.StructType([T.StructField("source", T.IntegerType())])
    return quality.table_schema_issues(table(spark, sf, "documents"), declared).where(
        "status <> 'ok'").select("column", "status", "filled_rows")


@query("freshness_check", """
SELECT max(ts) AS newest, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3.6e9 AS age_hours,
  (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3.6e9 <= 24 AS fresh FROM events""",
       doubles="age_hours")
def freshness_check(spark, sf):
    return quality.freshness_check(table(spark, sf, "events"), "ts", "2024-01-31 12:00:00")


@query("volume_anomaly_check", """
SELECT *, coalesce(abs(change) > 0.2, false) AS anomaly FROM (
  SELECT day, rows, previous_rows, (rows - previous_rows) * 1.0 / previous_rows AS change FROM (
    SELECT day, rows, lag(rows) OVER (ORDER BY day) AS previous_rows
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1)))""", doubles="change")
def volume_anomaly_check(spark, sf):
    return quality.volume_anomaly_check(table(spark, sf, "events"), "ts")


_PATTERN = ["description", "tags", "trending_date", "likes", "comments", "engagement_rate"]


@query("missing_pattern_check", enriched_sql(
    "SELECT concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _PATTERN)
    + ") AS missing_columns, count(*) AS rows FROM enriched GROUP BY 1"))
def missing_pattern_check(spark, sf):
    return quality.missing_pattern_check(enriched(spark, sf), _PATTERN)


def _outliers(c: str, reach: float) -> str:
    return (f"SELECT '{c}' AS \"column\", q1, q3, q1 - {reach} * (q3 - q1) AS low, q3 + {reach} * (q3 - q1) AS high, "
            f"(SELECT count(*) FROM trending WHERE {c} < q1 - {reach} * (q3 - q1) OR {c} > q3 + {reach} * (q3 - q1)) "
            f"AS outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM trending)")


@query("outlier_pattern_check", with_tables(
    " UNION ALL ".join(_outliers(c, 3.0) for c in clean.CAPPED), "trending"), doubles="q1 q3 low high")
def outlier_pattern_check(spark, sf):
    return quality.outlier_pattern_check(trending(spark, sf))


@query("exact_percentiles", """
SELECT event_type, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type""", doubles="p01 p50 p99")
def exact_percentiles(spark, sf):
    """The order statistics behind fences, medians and box plots, per group."""
    return exact_quantiles(table(spark, sf, "events"), ["event_type"], "value",
                           {"p01": 0.01, "p50": 0.5, "p99": 0.99})
