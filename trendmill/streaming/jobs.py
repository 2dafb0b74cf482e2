"""The event-driven jobs as Structured Streaming queries.

Each takes a folder that files arrive in, works through what is there
(``availableNow``) and stops; a scheduler or a plain trigger runs it again.
State and progress live in the checkpoint folder, so a restart after a lost
driver or executor continues where it stopped.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendmill.operators import quality
from trendmill.session import scratch_path
from trendmill.sources.files import items_to_rows
from trendmill.sources.versions import complete_numbers


def _now(stream: DataFrame, checkpoint: str):
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _checkpoint(spark: SparkSession, path: str | None) -> str:
    return path or scratch_path(spark, "stream-state")


def stream_json_to_parquet(spark: SparkSession, landing: str, target: str, schema: T.StructType,
                           checkpoint: str | None = None, multi_line: bool = True) -> DataFrame:
    """New documents ``{items: [...]}`` become flat rows appended to a Parquet dataset."""
    documents = spark.readStream.schema(schema).option("multiLine", multi_line).json(landing)
    rows = items_to_rows(documents)
    _now(rows, _checkpoint(spark, checkpoint)).format("parquet").option("path", target).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


def stream_validate(spark: SparkSession, landing: str, target: str, schema: T.StructType,
                    suite=quality.SUITE, order: str | None = None, files_per_batch: int = 1000,
                    checkpoint: str | None = None) -> DataFrame:
    """Every new batch of files is scored by the whole suite; one report row per batch.

    ``order`` is the column that orders the rows, for suites with an order check.

    The report folder carries the batch number and is overwritten, so a batch
    that is replayed after a failure does not report twice.
    """
    def score(batch: DataFrame, number: int) -> None:
        results = quality.run_suite(batch, suite, order)
        report = quality.quality_score(results).withColumns({
            "record_count": batch.agg(F.count("*")).scalar()})
        report.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    _now(stream, _checkpoint(spark, checkpoint)).foreachBatch(score).start().awaitTermination()
    return spark.read.parquet(target)


def _newest_manifest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> number of the batch that wrote it last; empty before the first batch.

    A manifest counts once it is complete, which its writer's success file tells.
    """
    numbers = complete_numbers(spark, f"{target}/manifest", "")
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return {}
    rows = spark.read.schema("bucket int, batch long").json(f"{target}/manifest/{max(numbers)}").collect()  # one row a bucket
    return {r["bucket"]: r["batch"] for r in rows}


def _buckets(spark: SparkSession, target: str, schema: T.StructType, held: dict[int, int], wanted=None) -> DataFrame:
    paths = [f"{target}/data/batch={n}/bucket={b}" for b, n in sorted(held.items()) if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_dashboard(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The figures of the newest complete refresh; later refreshes do not touch the files it reads."""
    return _buckets(spark, target, schema, _newest_manifest(spark, target))


def stream_dashboard_refresh(spark: SparkSession, landing: str, target: str, schema: T.StructType,
                             checkpoint: str | None = None, buckets: int = 64) -> DataFrame:
    """Running figures per channel; a batch rewrites the buckets of the channels it changed and no others.

    State is one row per channel, combined before it is shuffled.  New buckets are written beside the
    old ones and a small manifest says which are valid, so a reader sees the last refresh or
    this one, never half of it, and a batch replayed after a failure writes the same again.
    """
    events = spark.readStream.schema(schema).parquet(landing)
    running = events.groupBy("channel_title").agg(
        F.count("*").alias("videos"), F.sum("views").alias("total_views"), F.max("views").alias("max_views"),
        F.min("publish_date").alias("first_seen"), F.max("publish_date").alias("last_seen"))

    def publish(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = F.pmod(F.xxhash64("channel_title"), F.lit(buckets)).cast("int")
        changed = batch.withColumn("bucket", own).persist()
        try:
            touched = {r["bucket"] for r in changed.select("bucket").distinct().collect()}  # at most ``buckets``
            held = _newest_manifest(session, target, number)
            before = _buckets(session, target, batch.schema, held, touched).withColumn("bucket", own)
            new = changed.select("bucket", F.col("channel_title").alias("_new"))
            kept = before.join(new, (before["bucket"] == new["bucket"]) & before["channel_title"].eqNullSafe(F.col("_new")), "left_anti")
            if touched:
                (kept.unionByName(changed).write.mode("overwrite").partitionBy("bucket")
                 .option("partitionOverwriteMode", "static").parquet(f"{target}/data/batch={number}"))
            held |= dict.fromkeys(touched, number)
            session.createDataFrame(sorted(held.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").json(
                f"{target}/manifest/{number}")
        finally:
            changed.unpersist()

    (_now(running, _checkpoint(spark, checkpoint)).outputMode("update").foreachBatch(publish)
     .start().awaitTermination())
    return read_dashboard(spark, target, running.schema)


def stream_daily_views(spark: SparkSession, landing: str, target: str, schema: T.StructType,
                       lateness: str = "1 hour", checkpoint: str | None = None) -> DataFrame:
    """Views per day, written once a day is closed: later rows than ``lateness`` are dropped."""
    events = spark.readStream.schema(schema).parquet(landing)
    # Watermarks need an instant, not a local date-time.
    timed = events.withColumn("ts", F.col("publish_date").cast("timestamp")).withWatermark("ts", lateness)
    daily = timed.groupBy(F.window("ts", "1 day")).agg(
        F.sum("views").alias("views"), F.count("*").alias("videos"))
    closed = daily.select(F.to_date("window.start").alias("date"), "views", "videos")
    (_now(closed, _checkpoint(spark, checkpoint)).outputMode("append").format("parquet").option("path", target)
     .start().awaitTermination())
    return spark.read.schema(closed.schema).parquet(target)


@contextmanager
def _state_on_disk(spark: SparkSession):
    """State kept by RocksDB in the task's working folder, with changes saved to the checkpoint; not on the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_dedup(spark: SparkSession, landing: str, target: str, schema: T.StructType, keys,
                 checkpoint: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """First arrival of each key, however late and with whatever nulls (null keys are equal).

    The keys seen are keyed state, spread over the shuffle partitions: a batch costs its own rows and look-ups,
    whatever came before, and nothing is forgotten.  The checkpoint holds state and progress, the
    file sink a batch log, so a restart neither repeats nor loses rows.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    with _state_on_disk(spark):
        (_now(rows.dropDuplicates(list(keys)), _checkpoint(spark, checkpoint)).format("parquet").option("path", target)
         .start().awaitTermination())
    return spark.read.schema(schema).parquet(target)
