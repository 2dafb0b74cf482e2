"""S*, K*: reading landed files and writing tables, compared after a round trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import TRENDING_ORDER, table, trending, videos
from trendmill.operators import clean, joins, quality
from trendmill.plans import landing
from trendmill.plans.clean_queries import BATCH_TABLE_SQL
from trendmill.plans.evaluation_queries import model_metrics, models_sql
from trendmill.plans.quality_queries import _SCORE, checked, suite_sql
from trendmill.plans.registry import query
from trendmill.plans.sqltext import enriched_sql, ratio, tag_count, titles, videos_sql, words
from trendmill.plans.tables import scored
from trendmill.session import scratch_path
from trendmill.sources import files, sinks

NOW = "2002-01-01 00:00:00"
_LOADER = "('US', 'GB', 'IN', 'FR')"


def _ntz(df: DataFrame) -> DataFrame:
    """Plain timestamps, as the tables have them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields
                           if f.dataType.typeName() == "timestamp"})


# An empty CSV field is a missing value, whether it was empty or null before.
_REGION_DESCRIPTION = ("CASE WHEN seq % 9 = 2 THEN 'first line' || chr(10) || 'said \"hi\", then left' "
                       "ELSE nullif(description, '') END")


def _standard_sql(category_name: str, where: str) -> str:
    d = "description"
    return f"""
SELECT video_id, title, {d}, coalesce(tags, '') AS tags, CAST({tag_count("coalesce(tags, '')", '[|]')} AS INTEGER) AS tag_count,
  category_id, {category_name} AS category_name, '' AS channel_id, channel_title, publish_date,
  TIMESTAMP '{NOW}' AS trending_date, region_code, views, coalesce(likes, 0) AS likes,
  coalesce(comments, 0) AS comments,
  (coalesce(likes, 0) + coalesce(comments, 0)) * 1.0 / CASE WHEN views = 0 THEN 1 ELSE views END AS engagement_rate,
  CAST(length(title) AS INTEGER) AS title_length, CAST(coalesce(length({d}), 0) AS INTEGER) AS description_length,
  CAST(len({words('title')}) AS INTEGER) AS title_word_count, 'http://img/' || video_id AS thumbnail_url,
  TIMESTAMP '{NOW}' AS extracted_at
FROM (SELECT * REPLACE ({_REGION_DESCRIPTION} AS description) FROM videos) WHERE {where}"""


def standardized(spark, sf):
    folder = landing.land_regions(spark, sf)
    path = landing.land_json(landing.category_documents(spark, sf), "categories")
    names = files.load_category_reference(spark, path, multi_line=False).distinct()
    return files.standardize_columns(files.load_all_regions(spark, folder), names, F.lit(NOW))


_TOPIC = ("CASE WHEN category_id % 11 <> 0 AND category_id % 6 <> 0 THEN 'Topic ' || category_id END")


@query("standardize_columns", videos_sql(_standard_sql(_TOPIC, f"region_code IN {_LOADER}")), doubles="engagement_rate")
def standardize_columns(spark, sf):
    return _ntz(standardized(spark, sf))


_EMPTY_AS_NULL = "REPLACE (" + ", ".join(
    f"nullif({c}, '') AS {c}" for c in ("description", "tags", "channel_id")) + ")"


@query("load_any_format", videos_sql(
    " UNION ALL ".join(
        f"SELECT '{fmt}' AS fmt, * {change} FROM ({_standard_sql('CAST(NULL AS VARCHAR)', 'true')})"
        for fmt, change in (("parquet", ""), ("json", ""), ("csv", _EMPTY_AS_NULL)))), doubles="engagement_rate")
def load_any_format(spark, sf):
    """The same table landed in all three formats, found out by the loader."""
    rows = landing.region_rows(spark, sf).withColumn("region_code", F.substring("file", 1, 2)).withColumn(
        "description", F.nullif(F.col("description"), F.lit("")))
    standard = files.standardize_columns(rows, None, F.lit(NOW))
    parts = []
    for fmt in ("parquet", "json", "csv"):
        path = scratch_path(spark, f"any-{fmt}")
        source = standard
        if fmt == "csv":  # its reader here splits lines, so line breaks travel as a marker
            source = standard.withColumn("description", F.replace("description", F.lit("\n"), F.lit("\\n")))
        writer = source.write.option("escape", '"')
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        loaded = files.load_any_format(spark, path)
        if fmt == "parquet":  # the other formats are landed from this copy, so the table is put together once
            standard = spark.read.schema(standard.schema).parquet(path)
        if fmt == "csv":
            loaded = loaded.withColumn("description", F.replace("description", F.lit("\\n"), F.lit("\n")))
        parts.append(loaded.withColumn("fmt", F.lit(fmt)))
    return _ntz(reduce(DataFrame.unionByName, parts))


@query("load_by_extension", " UNION ALL ".join(
    f"SELECT '{fmt}' AS fmt, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
    for fmt in ("parquet", "csv", "json")), doubles="c_acctbal:2")
def load_by_extension(spark, sf):
    customer, parts = table(spark, sf, "customer"), []
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, "extension") + f".{fmt}"
        customer.write.option("header", True).format(fmt).save(path)
        loaded = files.load_by_extension(spark, path)
        parts.append(loaded.select(F.lit(fmt).alias("fmt"), *[
            F.col(f.name).cast(f.dataType).alias(f.name) for f in customer.schema.fields]))
    return reduce(DataFrame.unionByName, parts)


_CSV_SQL = f"""
SELECT video_id, title, channel_title, CAST(category_id AS VARCHAR) AS category_id,
  nullif(tags, '') AS tags, CAST(views AS VARCHAR) AS views, CAST(likes AS VARCHAR) AS likes, CAST(comments AS VARCHAR) AS comment_count,
  {_REGION_DESCRIPTION} AS description, region_code FROM videos"""
_CSV_COLUMNS = ["video_id", "title", "channel_title", "category_id", "tags", "views", "likes",
                "comment_count", "description", "region_code"]


@query("load_region_csv", videos_sql(f"{_CSV_SQL} WHERE region_code = 'GB'"))
def load_region_csv(spark, sf):
    folder = scratch_path(spark, "region")
    rows = landing.region_rows(spark, sf).where("file = 'GBvideos.csv'").drop("file")
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/GBvideos.csv")
    return files.load_region_csv(spark, folder, "GB").select(*_CSV_COLUMNS)


@query("load_all_regions", videos_sql(f"{_CSV_SQL} WHERE region_code IN {_LOADER}"))
def load_all_regions(spark, sf):
    return files.load_all_regions(spark, landing.land_regions(spark, sf)).select(*_CSV_COLUMNS)


_ODD = "(region_code = 'IN' AND coalesce(tags, '') LIKE '%,%')"
_MIXED_SQL = _CSV_SQL.replace(_REGION_DESCRIPTION, f"CASE WHEN region_code = 'IN' THEN 'plain' ELSE {_REGION_DESCRIPTION} END")


@query("load_regions", videos_sql(f"{_MIXED_SQL} WHERE region_code IN ('US', 'IN', 'FR') AND NOT {_ODD}"))
def load_regions(spark, sf):
    """Regions with different headers, one without a needed column, one with broken records."""
    done = files.load_regions(spark, landing.land_mixed_regions(spark, sf), scratch_path(spark, "loaded"))
    return done.rows.select(*_CSV_COLUMNS)


@query("region_load_report", videos_sql(f"""
SELECT region_code, if(region_code = 'GB', 'rejected', 'loaded') AS status,
  count(*) FILTER (WHERE region_code <> 'GB' AND NOT {_ODD}) AS rows, count(*) FILTER (WHERE {_ODD}) AS broken_rows,
  CASE WHEN region_code = 'GB' THEN 'columns missing: views' END AS reason
FROM videos WHERE region_code IN {_LOADER} GROUP BY region_code"""))
def region_load_report(spark, sf):
    """What became of each region, with the reason for a refusal."""
    return files.load_regions(spark, landing.land_mixed_regions(spark, sf), scratch_path(spark, "loaded")).report


@query("missing_regions", videos_sql(f"""
SELECT r AS region_code FROM (SELECT unnest([{', '.join(f"'{r}'" for r in K.LOADER_REGIONS)}]) AS r)
WHERE r NOT IN (SELECT region_code FROM videos)"""))
def missing_regions(spark, sf):
    return files.missing_regions(spark, landing.land_regions(spark, sf))


_ITEMS = """items AS (SELECT DISTINCT region_code, category_id AS c FROM videos)"""


@query("load_category_reference", videos_sql("""
SELECT CAST(c AS VARCHAR) AS id, 'Topic ' || c AS title FROM items WHERE c % 11 <> 0 AND c % 6 <> 0""", _ITEMS))
def load_category_reference(spark, sf):
    path = landing.land_json(landing.category_documents(spark, sf), "categories")
    return files.load_category_reference(spark, path, multi_line=False)


@query("json_items_to_rows", videos_sql("""
SELECT CASE WHEN c % 11 <> 0 THEN CAST(c AS VARCHAR) END AS id,
  CASE WHEN c % 6 <> 0 THEN 'Topic ' || c END AS snippet_title, c % 2 = 0 AS snippet_assignable,
  'UC' || region_code AS snippet_channelId FROM items""", _ITEMS))
def json_items_to_rows(spark, sf):
    """Dots in the flattened names become underscores only here, for the comparison."""
    path = landing.land_json(landing.category_documents(spark, sf), "categories")
    rows = files.json_items_to_rows(spark, path, multi_line=False)
    return rows.toDF(*[c.replace(".", "_") for c in rows.columns])


@query("flatten_category_documents", videos_sql("""
SELECT CAST(CASE WHEN c % 11 <> 0 THEN c END AS INTEGER) AS category_id,
  CASE WHEN c % 6 <> 0 THEN 'Topic ' || c END AS title, c % 2 = 0 AS assignable,
  'UC' || region_code AS channel_id FROM items""", _ITEMS))
def flatten_category_documents(spark, sf):
    path = landing.land_json(landing.category_documents(spark, sf), "categories")
    return files.flatten_category_documents(spark, path, multi_line=False)


@query("filter_search_hits", "SELECT 'e' || event_id AS video_id FROM events WHERE event_type IN ('view', 'click')")
def filter_search_hits(spark, sf):
    path = landing.land_json(landing.search_documents(spark, sf), "search")
    return files.filter_search_hits(spark, path, multi_line=False)


_TAG_LIST = "CASE WHEN seq % 4 <> 0 AND tags IS NOT NULL THEN str_split(tags, '|') ELSE [] END"
_DOC_COUNTS = "coalesce(likes, 0) + coalesce(comments, 0)"


@query("flatten_video_documents", videos_sql(f"""
SELECT video_id, title, coalesce(description, '') AS description, array_to_string({_TAG_LIST}, '|') AS tags,
  CAST(len({_TAG_LIST}) AS INTEGER) AS tag_count,
  CAST(CASE WHEN seq % 8 <> 0 THEN category_id ELSE 0 END AS INTEGER) AS category_id, channel_id, channel_title,
  publish_date, TIMESTAMP '{NOW}' AS trending_date, 'US' AS region_code, views, coalesce(likes, 0) AS likes,
  coalesce(comments, 0) AS comments, duration,
  CAST((seq * 7 % 41) * 60 + seq % 60 AS INTEGER) AS duration_seconds, 'hd' AS definition, 'false' AS caption,
  'processed' AS status, 'public' AS privacy_status, seq % 3 = 1 AS license, 'rectangular' AS projection,
  'http://img/' || video_id AS thumbnail_url, TIMESTAMP '{NOW}' AS extracted_at,
  {ratio(f'({_DOC_COUNTS})', 'views')} AS engagement_rate, CAST(length(title) AS INTEGER) AS title_length,
  CAST(length(coalesce(description, '')) AS INTEGER) AS description_length,
  CAST(len({words('title')}) AS INTEGER) AS title_word_count FROM videos"""), doubles="engagement_rate")
def flatten_video_documents(spark, sf):
    path = landing.land_json(landing.video_documents(spark, sf), "api")
    items = spark.read.schema(files.VIDEO_DOCUMENT).json(path).select(F.inline("items"))
    flat = files.flatten_video_documents(items, F.lit("US"), F.lit(NOW))
    return _ntz(flat.withColumn("tags", F.concat_ws("|", "tags")))


_PREDICTED = ["video_id", "category_id", "nlp_predicted_category", "nlp_category_confidence", "ml_predicted_views"]
_BATCHED = """
SELECT video_id, category_id, CAST(nlp_predicted_category AS INTEGER) AS nlp_predicted_category,
  nlp_category_confidence, ml_predicted_views, DATE '2024-01-01' + CAST(seq % 3 AS INTEGER) AS batch_date
FROM enriched"""


def _land_predictions(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("seq") % 3).cast("int"))
    rows = scored(spark, sf).select(*_PREDICTED, day.alias("day"))
    return sinks.write_predictions(rows, scratch_path(spark, "predictions"), F.col("day")).drop("day")


@query("write_predictions", enriched_sql(_BATCHED), doubles="nlp_category_confidence ml_predicted_views")
def write_predictions(spark, sf):
    return _land_predictions(spark, sf)


@query("read_latest_batch", enriched_sql(f"SELECT * FROM ({_BATCHED}) WHERE batch_date = DATE '2024-01-03'"),
       doubles="nlp_category_confidence ml_predicted_views")
def read_latest_batch(spark, sf):
    return files.read_latest_batch(_land_predictions(spark, sf))


@query("landing_inventory", videos_sql("SELECT DISTINCT region_code, true AS has_objects, true AS has_bytes FROM videos"))
def landing_inventory(spark, sf):
    """Object counts and sizes depend on the writer, so only their presence is compared."""
    listed = files.landing_inventory(spark, landing.land_regions(spark, sf))
    region = F.regexp_extract("path", r"([A-Z]{2})videos\.csv", 1).alias("region_code")
    totals = files.inventory_totals(listed.where("path LIKE '%.csv'"), region)
    return totals.select("region_code", (F.col("objects") > 0).alias("has_objects"), (F.col("bytes") > 0).alias("has_bytes"))


_KEPT = ["video_id", "title", "channel_title", "publish_date", "trending_date", "views", "likes", "comments",
         "region_code", "category_id"]
_KEPT_SQL = f"SELECT {', '.join(_KEPT)} FROM videos"


@query("write_partitioned_parquet", videos_sql(_KEPT_SQL))
def write_partitioned_parquet(spark, sf):
    return sinks.write_partitioned_parquet(videos(spark, sf).select(*_KEPT), scratch_path(spark, "clean"))


@query("register_table", videos_sql(_KEPT_SQL))
def register_table(spark, sf):
    path = scratch_path(spark, "registered")
    written = sinks.write_partitioned_parquet(videos(spark, sf).select(*_KEPT), path)
    return sinks.register_table(written, path, "videos_" + path.rsplit("-", 1)[-1])


@query("write_raw_zone", videos_sql(" UNION ALL ".join(
    f"SELECT '{fmt}' AS fmt, DATE '2024-03-01' AS ingest_date, {', '.join(_KEPT)} FROM videos"
    for fmt in ("parquet", "csv", "json"))))
def write_raw_zone(spark, sf):
    df, day = videos(spark, sf).select(*_KEPT), F.lit("2024-03-01")
    parts = [sinks.write_raw_zone(df, scratch_path(spark, f"raw-{fmt}"), day, fmt).withColumn("fmt", F.lit(fmt))
             for fmt in ("parquet", "csv", "json")]
    return reduce(DataFrame.unionByName, parts)


@query("append_or_overwrite_dataset", """
SELECT 'append' AS mode, * FROM customer UNION ALL SELECT 'append', * FROM customer
UNION ALL SELECT 'overwrite', * FROM customer""")
def append_or_overwrite_dataset(spark, sf):
    customer, parts = table(spark, sf, "customer"), []
    for mode in ("append", "overwrite"):
        path = scratch_path(spark, f"dataset-{mode}")
        sinks.append_or_overwrite_dataset(customer, path, mode)
        parts.append(sinks.append_or_overwrite_dataset(customer, path, mode).withColumn("mode", F.lit(mode)))
    return parts[0].unionByName(parts[1])


@query("write_quality_report", enriched_sql(f"""
SELECT {_SCORE}, 'videos' AS file_key, (SELECT count(*) FROM enriched) AS record_count, 34 AS results
FROM ({suite_sql(quality.TABLE_RULES)})"""), doubles="quality_score:2")
def write_quality_report(spark, sf):
    """The nested results are shown by their number."""
    df = checked(spark, sf)
    results = quality.run_suite(df, quality.TABLE_RULES, order="seq")
    report = sinks.write_quality_report(
        results, quality.quality_score(results), scratch_path(spark, "report"), "videos",
        F.lit(NOW), df.agg(F.count("*")).scalar())
    return report.withColumn("results", F.size("results")).drop("validated_at")


@query("write_evaluation_summary", models_sql("SELECT * FROM models"), doubles="accuracy f1 r2 rmse:3")
def write_evaluation_summary(spark, sf):
    return sinks.write_evaluation_summary(model_metrics(spark, sf), scratch_path(spark, "evaluation"))


@query("export_sample", videos_sql(
    f"SELECT {', '.join(_KEPT)} FROM videos ORDER BY md5(video_id || '#42'), video_id LIMIT 1000"))
def export_sample(spark, sf):
    return sinks.export_sample(videos(spark, sf).select(*_KEPT), scratch_path(spark, "sample"))


@query("deterministic_sample", "SELECT * FROM customer ORDER BY md5(c_custkey || '#7'), c_custkey LIMIT 50",
       doubles="c_acctbal:2")
def deterministic_sample(spark, sf):
    from trendmill.operators.metrics import sample_rows
    return sample_rows(table(spark, sf, "customer"), 50, seed=7, key="c_custkey")


@query("export_category_map", videos_sql(f"""
SELECT region_code, string_agg(category_id || '=' || title, ',' ORDER BY category_id) AS categories
FROM (SELECT DISTINCT region_code, category_id, {titles('category_id', 'NULL')} AS title FROM videos)
WHERE title IS NOT NULL GROUP BY 1"""))
def export_category_map(spark, sf):
    named = joins.enrich_with_category(videos(spark, sf), joins.category_dimension(spark))
    out = sinks.export_category_map(named, scratch_path(spark, "maps"))
    pairs = F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    by_id = F.array_sort(pairs, lambda a, b: F.split(a, "=")[0].cast("int") - F.split(b, "=")[0].cast("int"))
    return out.select("region_code", F.concat_ws(",", by_id).alias("categories"))


@query("export_filtered_csv", videos_sql(
    f"SELECT {', '.join(_KEPT)} FROM videos WHERE region_code IN ('US', 'IN') AND views >= 500000"))
def export_filtered_csv(spark, sf):
    from trendmill.operators.filters import apply_dashboard_filters
    chosen = apply_dashboard_filters(videos(spark, sf), regions=["US", "IN"], views=(500_000, None))
    return sinks.export_filtered_csv(chosen.select(*_KEPT), scratch_path(spark, "export"))


@query("union_all_regions", videos_sql(_standard_sql(_TOPIC, f"region_code IN {_LOADER}")), doubles="engagement_rate")
def union_all_regions(spark, sf):
    """All regions, each video landed twice; the later copy of a video is kept."""
    once = standardized(spark, sf)
    older = once.withColumns({"extracted_at": F.col("extracted_at") - F.expr("INTERVAL 1 DAY"),
                              "title": F.concat(F.lit("old "), "title")})
    both = older.unionByName(once, allowMissingColumns=True)
    return _ntz(clean.dedup_keep_last(both, ["video_id"], ["extracted_at", "region_code"]))


@query("etl_run", BATCH_TABLE_SQL, doubles="engagement_rate time_to_trending_hours")
def etl_run(spark, sf):
    """Load, clean, transform, write, register: the batch job from end to end."""
    landed = scratch_path(spark, "etl-raw")
    trending(spark, sf).write.parquet(landed)
    target = scratch_path(spark, "etl-clean")
    return run_batch(spark, landed, target, "etl_" + target.rsplit("-", 1)[-1])


def run_batch(spark, source: str, target: str, name: str) -> DataFrame:
    """A run replaces the table's rows; until it ends, and if it dies, the name shows those of the run before."""
    raw = files.load_by_extension(spark, source, "parquet")
    columns = raw.columns
    done = clean.batch_transform(clean.batch_clean(raw, TRENDING_ORDER))
    return sinks.publish_partitioned(done, target, name).select(
        *columns, *[c for c in done.columns if c not in columns])


_FILES = ["US", "GB", "IN", "FR", "XX"]


@query("validate_files", enriched_sql(" UNION ALL ".join(
    f"SELECT '{r}' AS file, {_SCORE}, (SELECT count(*) FROM rows_{r}) AS record_count "
    f"FROM ({suite_sql(quality.SUITE, f'rows_{r}')})" for r in _FILES),
    ",\n".join(f"rows_{r} AS (SELECT * FROM enriched WHERE region_code = '{r}')" for r in _FILES)),
       doubles="quality_score:2")
def validate_files(spark, sf):
    """Files land per region; a file is named by its region folder."""
    path = scratch_path(spark, "files")
    checked(spark, sf).withColumn("folder", F.col("region_code")).hint("rebalance", "folder").write.partitionBy(
        "folder").parquet(path)
    landed = spark.read.schema(checked(spark, sf).schema).parquet(path).withColumn(
        "file", F.regexp_extract(F.col("_metadata.file_path"), "folder=([A-Z]+)", 1))
    return quality.validate_files(landed, quality.SUITE, order="seq")
