"""Writing tables, exports and reports.  Each writer returns what a reader then sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill.operators.metrics import sample_rows
from trendmill.sources.versions import (
    append_version, current_folder, point_table, publish_table, replace_version,
)

ROWS_PER_FILE = 5_000_000


def _rebalanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows brought together by output folder.

    A rebalance, not a repartition: AQE splits a hot folder over as many tasks
    as its bytes need and merges small ones.
    """
    return df.hint("rebalance", *keys)


def write_partitioned_parquet(df: DataFrame, path: str, keys=("region_code", "category_id"),
                              mode: str = "overwrite") -> DataFrame:
    """Snappy Parquet in one folder per key combination.

    Only the partitions at hand are overwritten, so a daily run leaves others alone.
    """
    (_rebalanced(df, list(keys)).write.mode(mode).partitionBy(*keys)
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path))
    return df.sparkSession.read.parquet(path)


def register_table(df: DataFrame, path: str, table: str) -> DataFrame:
    """Make written Parquet readable under a catalogue name, whose earlier meaning holds until the switch.

    ``df`` is the read-back frame of the path, whose columns and partition keys it declares.
    """
    return point_table(df, path, table)


def publish_partitioned(df: DataFrame, path: str, table: str, keys=("region_code", "category_id")) -> DataFrame:
    """The batch job's clean table: a new version in folders by key, and the catalogue name switched to it."""
    return publish_table(df, path, table, keys, compression="snappy", maxRecordsPerFile=ROWS_PER_FILE)


def write_raw_zone(df: DataFrame, path: str, ingest_date: Column, fmt: str = "parquet") -> DataFrame:
    """``region_code=../ingest_date=..`` folders in Parquet, CSV or JSON."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"Unsupported file format: {fmt}")
    keys = ["region_code", "ingest_date"]
    dated = df.withColumn("ingest_date", ingest_date.cast("date"))
    writer = _rebalanced(dated, keys).write.mode("overwrite").partitionBy(*keys)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if fmt == "json":
        writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
    writer.format(fmt).save(path)
    reader = df.sparkSession.read
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    stored = [f for f in dated.schema.fields if f.name not in keys]
    schema = type(dated.schema)(stored + [dated.schema[k] for k in keys])
    return reader.schema(schema).format(fmt).load(path)


def append_or_overwrite_dataset(df: DataFrame, path: str, mode: str = "append",
                                table: str | None = None) -> DataFrame:
    """Add to or replace a dataset; optionally under a catalogue name.

    Rows are added to the current version and replaced by a new one, so readers never find a half-written dataset.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    written = (append_version if mode == "append" else replace_version)(df, path)
    return point_table(written, current_folder(df.sparkSession, path), table) if table else written


def write_predictions(df: DataFrame, path: str, batch_date: Column) -> DataFrame:
    """Scored rows, one partition per batch."""
    (df.withColumn("batch_date", batch_date.cast("date")).write.mode("overwrite")
     .partitionBy("batch_date").option("partitionOverwriteMode", "dynamic").parquet(path))
    return df.sparkSession.read.parquet(path)


def write_quality_report(results: DataFrame, scores: DataFrame, path: str, file_key: str,
                         stamp: Column, record_count: Column) -> DataFrame:
    """A JSON report: score, verdict and the single results (one row, a few dozen results)."""
    listed = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns)))).scalar()
    report = scores.withColumns({
        "file_key": F.lit(file_key), "record_count": record_count, "validated_at": stamp,
        "results": listed})
    report.write.mode("overwrite").json(path)
    return results.sparkSession.read.schema(report.schema).json(path)


def write_evaluation_summary(metrics: DataFrame, path: str) -> DataFrame:
    """One CSV row per model."""
    metrics.write.mode("overwrite").option("header", True).csv(path)
    return metrics.sparkSession.read.schema(metrics.schema).option("header", True).csv(path)


def export_filtered_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option(
        "escape", '"').option("multiLine", True).csv(path)


def export_sample(df: DataFrame, path: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """A repeatable sample as CSV."""
    return export_filtered_csv(sample_rows(df, n, seed), path)


def export_category_map(df: DataFrame, path: str) -> DataFrame:
    """Per region the map category id -> title, as JSON (regions times categories is small)."""
    entries = F.array_sort(F.collect_set(F.struct("category_id", "category_title")))
    known = df.where("category_title IS NOT NULL").groupBy("region_code").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(
            e["category_id"].cast("string"), e["category_title"]))).alias("categories"))
    known.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(known.schema).json(path)
