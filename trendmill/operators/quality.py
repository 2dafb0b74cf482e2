"""Declarative expectations, compiled into aggregates.

A suite is a list of ``(type, kwargs)``.  All row-level and plain aggregate
expectations share one ``agg``; those that need distinct counts, order
statistics or row order run as one extra frame each.  Results have one row per
expectation: ``id, expectation, column, success, observed, unexpected_count,
message``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendmill import constants as K
from trendmill import schema as zones
from trendmill.operators.clean import outlier_counts
from trendmill.operators.ordering import order_breaks
from trendmill.operators.ranks import exact_quantiles, null_safe_join

_NUMERIC = {"int64": (T.LongType, T.IntegerType), "float64": (T.DoubleType, T.FloatType),
            "datetime64[ns]": (T.TimestampType, T.TimestampNTZType),
            "object": (T.StringType,), "bool": (T.BooleanType,)}

# The standard suite.  Fixed values; the order is the order of the report.
_EXPECTED_COLUMNS = [
    "video_id", "title", "description", "tags", "category_id", "channel_title", "publish_date",
    "trending_date", "region_code", "views", "likes", "comments", "engagement_rate", "title_length",
    "description_length", "tag_count", "title_word_count", "has_description", "has_tags",
    "engagement_category", "view_category",
]
SUITE = [
    *[("not_null", {"column": c}) for c in ("video_id", "title", "channel_title", "views", "likes")],
    ("unique", {"column": "video_id"}),
    ("in_set", {"column": "category_id", "values": list(range(1, 45))}),
    ("row_count", {"min": 100_000}),
    ("mean", {"column": "views", "min": 1000}),
    ("type", {"column": "views", "type": "int64"}),
    ("type", {"column": "likes", "type": "int64"}),
    ("type", {"column": "publish_date", "type": "datetime64[ns]"}),
    ("between", {"column": "views", "min": 0, "max": 10**12}),
    ("between", {"column": "likes", "min": 0, "max": 10**11}),
    ("between", {"column": "comments", "min": 0, "max": 10**10}),
    ("not_match", {"column": "title", "pattern": r"^\s*$"}),
    ("length", {"column": "title", "min": 1, "max": 200}),
    ("length", {"column": "description", "min": 0, "max": 5000}),
    ("in_set", {"column": "region_code", "values": K.SUITE_REGIONS}),
    ("between", {"column": "engagement_rate", "min": 0, "max": 1}),
    ("unique_proportion", {"column": "channel_title", "min": 0.001, "max": 1.0}),
    ("increasing", {"column": "trending_date"}),
    ("not_null", {"column": "category_id"}),
    ("type", {"column": "category_id", "type": "int64"}),
    ("compound_unique", {"columns": ["video_id", "trending_date"]}),
    ("not_null", {"column": "region_code"}),
    ("match", {"column": "region_code", "pattern": "^[A-Z]{2}$"}),
    ("median", {"column": "views", "min": 100, "max": 10**7}),
    ("stdev", {"column": "views", "min": 0, "max": 10**8}),
    ("pair_greater", {"a": "likes", "b": "comments"}),
    ("columns_ordered", {"columns": _EXPECTED_COLUMNS}),
    ("not_null", {"column": "extracted_at"}),
    ("between", {"column": "title_word_count", "min": 1, "max": 100}),
    ("between", {"column": "tag_count", "min": 0, "max": 50}),
    ("in_set", {"column": "engagement_category", "values": ["Low", "Medium", "High"]}),
    ("in_set", {"column": "view_category", "values": ["Low", "Medium", "High", "Viral"]}),
    ("type", {"column": "has_description", "type": "bool"}),
    ("type", {"column": "has_tags", "type": "bool"}),
]

# The second, code-level validator's rules.
TABLE_RULES = [
    *[("exists", {"column": c}) for c in ("video_id", "title", "channel_title", "views", "likes",
                                          "comments", "category_id", "region_code")],
    *[("not_null", {"column": c}) for c in ("video_id", "title", "channel_title", "views", "likes")],
    ("unique", {"column": "video_id"}),
    ("between", {"column": "category_id", "min": 1, "max": 44}),
    ("between", {"column": "views", "min": 0, "max": 10**12}),
    ("between", {"column": "likes", "min": 0, "max": 10**11}),
    ("between", {"column": "comments", "min": 0, "max": 10**10}),
    ("length", {"column": "title", "min": 1, "max": 200}),
    ("length", {"column": "description", "min": 0, "max": 5000}),
    ("row_count", {"min": 100_000}),
    ("mean", {"column": "views", "min": 1000}),
    ("in_set", {"column": "region_code", "values": K.LOADER_REGIONS}),
    *[("type", {"column": c, "type": t}) for c, t in (
        ("video_id", "object"), ("title", "object"), ("channel_title", "object"), ("views", "int64"),
        ("likes", "int64"), ("comments", "int64"), ("category_id", "int64"), ("region_code", "object"))],
    ("between", {"column": "engagement_rate", "min": 0, "max": 1}),
    ("pair_mostly_not_less", {"a": "likes", "b": "comments", "tolerance": 0.1}),
    ("pair_not_before", {"a": "trending_date", "b": "publish_date"}),
]

RESULT = ("id int, expectation string, column string, success boolean, observed double, "
          "unexpected_count bigint, message string")


def _unexpected(kind: str, kw: dict) -> Column | None:
    """Condition a row must not meet; nulls pass, except in the null checks themselves."""
    column = F.col(kw["column"]) if "column" in kw else None
    if kind == "not_null":
        return column.isNull()
    if kind == "in_set":
        return ~column.isin(*kw["values"])
    if kind == "between":
        return (column < kw["min"]) | (column > kw["max"])
    if kind == "length":
        return (F.length(column) < kw["min"]) | (F.length(column) > kw["max"])
    if kind == "match":
        return ~F.regexp_like(column, F.lit(kw["pattern"]))
    if kind == "not_match":
        return F.regexp_like(column, F.lit(kw["pattern"]))
    if kind == "pair_greater":
        return F.col(kw["a"]) <= F.col(kw["b"])
    if kind in ("pair_mostly_not_less", "pair_not_before"):
        return F.col(kw["a"]) < F.col(kw["b"])
    return None


def _measure(kind: str, kw: dict) -> Column | None:
    if kind == "row_count":
        return F.count("*").cast("double")
    if kind == "mean":
        return F.avg(kw["column"])
    if kind == "stdev":
        return F.stddev_samp(kw["column"])
    return None


def _within(value: Column, kw: dict) -> Column:
    ok = value.isNotNull()
    if "min" in kw:
        ok = ok & (value >= kw["min"])
    if "max" in kw:
        ok = ok & (value <= kw["max"])
    return F.coalesce(ok, F.lit(False))


def _subject(kw: dict) -> str | None:
    if "column" in kw:
        return kw["column"]
    if "a" in kw:
        return f"{kw['a']},{kw['b']}"
    return None if "columns" not in kw else ",".join(kw["columns"][:2])


def _result(i: int, kind: str, kw: dict, success: Column, observed: Column, unexpected: Column) -> Column:
    message = F.when(success, F.lit("ok")).otherwise(
        F.concat(F.lit(f"{kind} failed on "), F.lit(_subject(kw) or "table")))
    return F.struct(
        F.lit(i).alias("id"), F.lit(kind).alias("expectation"), F.lit(_subject(kw)).alias("column"),
        success.alias("success"), observed.cast("double").alias("observed"),
        unexpected.cast("bigint").alias("unexpected_count"), message.alias("message"))


def _no(kind="double"):
    return F.lit(None).cast(kind)


def _schema_outcome(kind: str, kw: dict, schema: T.StructType) -> bool | None:
    """Verdict of the checks that need no data."""
    if kind == "exists":
        return kw["column"] in schema.names
    if kind == "type":
        return kw["column"] in schema.names and isinstance(
            schema[kw["column"]].dataType, _NUMERIC[kw["type"]])
    if kind == "columns_ordered":
        return schema.names == kw["columns"]
    return None


def _known(kw: dict, names) -> bool:
    used = [kw[k] for k in ("column", "a", "b") if k in kw] + list(kw.get("columns", []))
    return all(c in names for c in used)


def fused_results(df: DataFrame, suite, by: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Row-level, aggregate and schema expectations of a suite in one aggregate (per ``by`` group).

    ``schema`` is what the schema checks look at, if the frame has columns besides.
    """
    aggregates, results = [F.count("*").alias("rows")], []
    for i, (kind, kw) in enumerate(suite):
        verdict = _schema_outcome(kind, kw, schema or df.schema)
        if verdict is not None:
            results.append(_result(i, kind, kw, F.lit(verdict), _no(), F.lit(0 if verdict else 1)))
            continue
        if not _known(kw, df.columns):
            results.append(_result(i, kind, kw, F.lit(False), _no(), F.col("rows")))
            continue
        bad, measure = _unexpected(kind, kw), _measure(kind, kw)
        cell = F.col(f"m{i}")
        if bad is not None:
            aggregates.append(F.count_if(bad).alias(f"m{i}"))
            share = F.try_divide(cell.cast("double"), F.col("rows"))
            if kind == "pair_mostly_not_less":
                ok = F.coalesce(share <= kw["tolerance"], F.lit(True))
            else:
                ok = cell == 0
            results.append(_result(i, kind, kw, ok, share, cell))
        elif measure is not None:
            aggregates.append(measure.alias(f"m{i}"))
            results.append(_result(i, kind, kw, _within(cell, kw), cell, F.lit(0)))
    grouped = df.groupBy(*(by or [])).agg(*aggregates)
    return grouped.select(*(by or []), F.inline(F.array(*results)))


def _key_results(df: DataFrame, rules, by: list[str]) -> DataFrame:
    """Distinct and compound checks, ``rules`` as (id, kind, arguments), over one exchange for all of them.

    Every rule's columns are a grouping set, so the table is read once, rows combine by (rule, key) before the shuffle
    and a hot key arrives as a few counts.  The keys' counts then add up to one row (per ``by`` group).  All rules
    together may use 64 columns, Spark's limit for grouping sets.
    """
    keys = {i: list(dict.fromkeys([*by, *(kw["columns"] if kind == "compound_unique" else [kw["column"]])]))
            for i, kind, kw in rules}
    columns = list(dict.fromkeys(c for key in keys.values() for c in [*by, *key]))
    sets = list(dict.fromkeys(tuple(sorted(key, key=columns.index)) for key in keys.values()))
    counted = df.groupingSets([[F.col(c) for c in chosen] for chosen in sets], *map(F.col, columns)).agg(
        F.count("*").alias("__n"), F.grouping_id().alias("__set"))
    aggregates, results = [], []
    for i, kind, kw in rules:
        mask = sum(1 << place for place, c in enumerate(reversed(columns)) if c not in keys[i])
        own, n = F.col("__set") == mask, F.col("__n")
        own = own & (n > 1 if kind == "compound_unique" else F.col(kw["column"]).isNotNull())
        aggregates += [F.count_if(own).alias(f"__keys{i}"), F.coalesce(F.sum(F.when(own, n)), F.lit(0)).alias(f"__rows{i}")]
        found, rows = F.col(f"__keys{i}"), F.col(f"__rows{i}")
        if kind == "unique":
            results.append(_result(i, kind, kw, rows == found, found, rows - found))
        elif kind == "unique_proportion":
            share = F.try_divide(found, rows)
            results.append(_result(i, kind, kw, _within(share, kw), share, F.lit(0)))
        else:
            results.append(_result(i, kind, kw, rows == 0, found, rows))
    return counted.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*results)))


def _own_frame(df: DataFrame, i: int, kind: str, kw: dict, order: str | None, by: list[str]) -> DataFrame:
    """The result of a check that needs a frame of its own; one row, or one per ``by`` group."""
    column = F.col(kw["column"])
    if kind == "median":
        stats = _every_group(df, exact_quantiles(df, by, kw["column"], {"median": 0.5}), by)
        result = _result(i, kind, kw, _within(F.col("median"), kw), F.col("median"), F.lit(0))
    else:
        if order is None:
            raise ValueError("an increasing check needs the column that orders the rows")
        stats = _every_group(df, order_breaks(df, order, column, by=by), by)
        breaks = F.coalesce("breaks", F.lit(0))
        result = _result(i, kind, kw, breaks == 0, F.coalesce("checked", F.lit(0)), breaks)
    return stats.select(*by, F.inline(F.array(result)))


def _every_group(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """``stats`` with a row of nulls for the groups that have no value to measure."""
    return null_safe_join(df.select(*by).distinct(), stats, by, "left") if by else stats


def compound_duplicates(df: DataFrame, columns, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by`` group): keys that occur more than once and the rows that hold them."""
    by = by or []
    groups = df.groupBy(*by, *columns).agg(F.count("*").alias("n"))
    return groups.groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"),
                                   F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))


def run_suite(df: DataFrame, suite=SUITE, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Evaluate a whole suite, or, with ``by``, for every group of those columns.

    Row, aggregate and schema checks share one aggregate, distinct and compound checks one exchange of keys; medians
    and order checks take a frame each.
    """
    by = by or []
    tested = [c for c in df.columns if c != order and c not in by]
    separate = [kind in _SEPARATE and _known(kw, df.columns) for kind, kw in suite]
    frames = []
    if not all(separate):
        # Positions stay those of the suite, so the ids do too.
        shared = [("separate", {}) if own else rule for own, rule in zip(separate, suite)]
        frames.append(fused_results(df.select(*tested, *by), shared, by, df.select(*tested).schema))
    alone = [(i, kind, kw) for i, (own, (kind, kw)) in enumerate(zip(separate, suite)) if own]
    keyed = [rule for rule in alone if rule[1] in _KEYED]
    frames += [_key_results(df, keyed, by)] if keyed else []
    frames += [_own_frame(df, i, kind, kw, order, by) for i, kind, kw in alone if kind not in _KEYED]
    return reduce(DataFrame.unionByName, frames)


_KEYED = ("unique", "unique_proportion", "compound_unique")
_SEPARATE = (*_KEYED, "median", "increasing")


def load_suite(path: str) -> list:
    """A suite stored as JSON: a list of ``[type, arguments]``."""
    with open(path, encoding="utf-8") as source:
        return [(kind, kw) for kind, kw in json.load(source)]


def quality_score(results: DataFrame, by=()) -> DataFrame:
    passed = F.count_if("success")
    score = F.round(F.try_divide(passed * 100.0, F.count("*")), 2)
    return results.groupBy(*by).agg(
        F.count("*").alias("total_expectations"), passed.alias("successful_expectations"),
        F.count_if(~F.col("success")).alias("failed_expectations"),
        F.coalesce(score, F.lit(0.0)).alias("quality_score"),
        (F.coalesce(score, F.lit(0.0)) >= K.QUALITY_GATE).alias("passed"))


def quality_status(scores: DataFrame) -> DataFrame:
    """Bands of the score as a share: 0.95 success, 0.85 warning, 0.70 failure, below critical."""
    share = F.col("quality_score") / 100
    return scores.withColumn("status", F.when(share >= 0.95, "success").when(share >= 0.85, "warning")
                             .when(share >= 0.70, "failure").otherwise("critical"))


def failed_expectations(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success"))


def _rule_tests(df: DataFrame, rules: T.StructType) -> dict[str, Column]:
    """``field:rule`` -> condition of a row that breaks it."""
    out = {}
    for field in rules.fields:
        if field.name not in df.columns:
            continue
        c, meta = F.col(field.name), field.metadata or {}
        tests = {
            "null": c.isNull() if not field.nullable else None,
            "type": (c.isNotNull() & c.try_cast(field.dataType).isNull()
                     if df.schema[field.name].dataType != field.dataType else None),
            "min": c < meta["min"] if "min" in meta else None,
            "max": c > meta["max"] if "max" in meta else None,
            "min_length": F.length(c) < meta["min_length"] if "min_length" in meta else None,
            "max_length": F.length(c) > meta["max_length"] if "max_length" in meta else None,
            "pattern": ~F.regexp_like(c, F.lit(meta["pattern"])) if "pattern" in meta else None,
            "allowed": ~c.isin(*meta["allowed"]) if "allowed" in meta else None,
        }
        out |= {f"{field.name}:{rule}": test for rule, test in tests.items() if test is not None}
    return out


def row_violations(df: DataFrame, rules: T.StructType) -> DataFrame:
    """Adds ``violations``: names of the schema rules each row breaks."""
    broken = [F.when(test, F.lit(name)) for name, test in _rule_tests(df, rules).items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_report(df: DataFrame, rules: T.StructType) -> DataFrame:
    """Rows per broken rule: one aggregate, nothing exploded but its single row."""
    tests = _rule_tests(df, rules)
    counts = df.agg(*[F.count_if(test).alias(f"r{i}") for i, test in enumerate(tests.values())])
    listed = F.array(*[F.struct(F.lit(name).alias("violation"), F.col(f"r{i}").alias("rows"))
                       for i, name in enumerate(tests)])
    return counts.select(F.inline(listed)).where("rows > 0")


def table_schema_issues(df: DataFrame, rules: T.StructType) -> DataFrame:
    """Declared against actual columns, with the rows that hold a value: one row per column.

    ``status`` is ok, missing, type_mismatch or extra.
    """
    aggregates, rows = [], []
    declared = {f.name: f for f in rules.fields}
    for name in [*declared, *[c for c in df.columns if c not in declared]]:
        want = declared[name].dataType.simpleString() if name in declared else None
        have = df.schema[name].dataType.simpleString() if name in df.columns else None
        if have is None:
            status = "missing"
        elif want is None:
            status = "extra"
        else:
            status = "ok" if _same_kind(want, have) else "type_mismatch"
        filled = F.lit(0).cast("bigint")
        if have is not None:
            aggregates.append(F.count(F.col(name)).alias(f"n_{name}"))
            filled = F.col(f"n_{name}")
        required = name in declared and not declared[name].nullable
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(want).alias("declared"),
                             F.lit(have).alias("actual"), F.lit(status).alias("status"),
                             F.lit(required).alias("required"), filled.alias("filled_rows")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


_KINDS = {"int": "number", "bigint": "number", "double": "number", "float": "number",
          "timestamp": "time", "timestamp_ntz": "time"}


def _same_kind(a: str, b: str) -> bool:
    return _KINDS.get(a, a) == _KINDS.get(b, b)


def schema_drift_check(df: DataFrame, name: str = "cleaned") -> DataFrame:
    return table_schema_issues(df, zones.schema(name)).where("status <> 'ok'")


def freshness_check(df: DataFrame, column: str, as_of, max_age_hours: float = 24.0) -> DataFrame:
    """Age of the newest row against a limit; ``as_of`` stands for now."""
    newest = F.max(F.col(column))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(newest.cast("timestamp"))) / 3.6e9
    return df.agg(newest.alias("newest"), age.alias("age_hours")).withColumn(
        "fresh", F.coalesce(F.col("age_hours") <= max_age_hours, F.lit(False)))


def volume_anomaly_check(df: DataFrame, column: str, threshold: float = 0.2) -> DataFrame:
    """Rows per day against the day before; the window runs over days, not rows."""
    daily = df.where(F.col(column).isNotNull()).groupBy(F.to_date(column).alias("day")).agg(
        F.count("*").alias("rows"))
    change = F.try_divide(F.col("rows") - F.col("previous_rows"), F.col("previous_rows"))
    return (
        daily.withColumn("previous_rows", F.lag("rows").over(Window.orderBy("day")))
        .withColumn("change", change)
        .withColumn("anomaly", F.coalesce(F.abs("change") > threshold, F.lit(False)))
    )


def missing_pattern_check(df: DataFrame, columns) -> DataFrame:
    """Which columns are null together, and in how many rows."""
    names = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return df.groupBy(names.alias("missing_columns")).agg(F.count("*").alias("rows"))


def outlier_pattern_check(df: DataFrame, columns=("views", "likes", "comments"), reach: float = 3.0) -> DataFrame:
    return outlier_counts(df, list(columns), reach)


def validate_files(df: DataFrame, suite=SUITE, source: str = "file", order: str | None = None) -> DataFrame:
    """Score of every source file by the whole suite; ``order`` is the column that orders a file's rows."""
    scores = quality_score(run_suite(df, suite, order, [source]), [source])
    rows = df.groupBy(source).agg(F.count("*").alias("record_count"))
    return scores.join(rows, source)
