"""Reading landed files: tables, regional CSV, category documents, API documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendmill import constants as K
from trendmill.functions import engagement, text
from trendmill.schema import JOB_INPUT


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the declared columns; values that cannot be read become null."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the source: {missing}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _first_line(spark: SparkSession, path: str) -> str:
    """First line of one file, to tell JSON from CSV.  Reads one split at most."""
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0].strip() if rows else ""


def _is_record(line: str) -> bool:
    """Whether the line is a whole JSON object, as in a file of one object per line."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def load_any_format(spark: SparkSession, path: str, schema: T.StructType = JOB_INPUT) -> DataFrame:
    """Parquet if it opens as Parquet, else JSON (lines, arrays or documents over several lines), else CSV with a header; typed to ``schema``."""
    try:
        return _typed(spark.read.parquet(path), schema)
    except ValueError:
        raise
    except Exception as error:  # Spark says while reading a footer that it isn't Parquet
        if "is not a Parquet file" not in str(error):
            raise
        start = _first_line(spark, path)
        if start.startswith("PAR1"):  # it was meant to be: cut off or damaged
            raise
    if start.startswith(("{", "[")):
        # A declared text schema saves the inference pass over all files; what isn't JSON is refused.
        reader = spark.read.schema(_text_schema(schema)).option("mode", "FAILFAST")
        return _typed(reader.option("multiLine", not _is_record(start)).json(path), schema)
    if "," in start:
        return _typed(spark.read.option("header", True).option("escape", '"').csv(path), schema)
    raise ValueError(f"could not read {path} in any supported format")


def load_by_extension(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """Dispatch on the file name's ending (or the ending a directory was written with)."""
    kind = extension or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("escape", '"').csv(path)
    if kind == "json":
        return spark.read.json(path)
    raise ValueError(f"Unsupported file format: {path}")


REGION_CSV = T.StructType([T.StructField(c, T.StringType()) for c in (
    "video_id", "title", "channel_title", "category_id", "publish_time", "tags", "views", "likes",
    "dislikes", "comment_count", "thumbnail_link", "description")])


_BROKEN = "__broken"


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Regional CSV; quotes inside quoted fields are doubled, and another header than the known one is an error."""
    return (spark.read.schema(REGION_CSV).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("enforceSchema", False).csv(path))


def _region_of(path: Column) -> Column:
    """The two letters before ``videos.csv`` in a file or folder name."""
    return F.regexp_extract(path, r"([A-Z]{2})videos\.csv", 1)


def load_region_csv(spark: SparkSession, folder: str, region: str, multi_line: bool = True) -> DataFrame:
    """One region's CSV, a file or a folder of parts, its columns taken by the names in the header.

    Columns beyond the known ones are dropped, one that is missing is an error.  Fields may hold line breaks, so by
    default a file is read by one task: land large regions as folders of parts, or pass ``multi_line=False`` for files
    without line breaks in fields, which Spark can split.
    """
    if region not in K.LOADER_REGIONS:
        raise ValueError(f"Region {region} not supported. Supported regions: {K.LOADER_REGIONS}")
    return _by_header(spark, f"{folder}/{region}videos.csv", multi_line).select(
        *REGION_CSV.names, F.lit(region).alias("region_code"))


def _by_header(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The file's known columns and ``_BROKEN``, which holds the whole record where it has too few or too many fields.

    Every part must have the header of the first; Spark refuses others.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    missing = [c for c in REGION_CSV.names if c not in header]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _BROKEN]])
    return spark.read.options(**options, enforceSchema=False, columnNameOfCorruptRecord=_BROKEN).schema(schema).csv(path)


@dataclass
class LoadedRegions:
    """``rows`` of the regions that could be read, a ``report`` of one row a region found, and the ``broken`` records."""
    rows: DataFrame
    report: DataFrame
    broken: DataFrame


def load_regions(spark: SparkSession, folder: str, target: str, multi_line: bool = True) -> LoadedRegions:
    """Every supported region that is there, read once and written to ``target`` as Parquet; what can't be read is reported.

    A region whose columns are missing or whose files are damaged contributes no rows, and its report says why.  Records with
    too few or too many fields are set aside whole in ``broken``.  Regions without a file get no report row.  Runs a
    job a region, at most one for each supported region; ``target`` must be a new folder.
    """
    found = {r["region_code"] for r in region_files(spark, folder).select("region_code").distinct().collect()}
    report, loaded = [], []
    for region in sorted(found):
        path = f"{target}/region={region}"
        try:
            rows = _by_header(spark, f"{folder}/{region}videos.csv", multi_line).select(*REGION_CSV.names, _BROKEN)
            rows.write.mode("error").parquet(path)
        except (ValueError, PySparkException, Py4JJavaError) as error:  # what Spark raises for a file it can't read
            report.append((region, "rejected", str(error).splitlines()[0][:500]))
            continue
        report.append((region, "loaded", None))
        loaded.append(path)
    schema = T.StructType([*REGION_CSV.fields, T.StructField(_BROKEN, T.StringType())])
    every = spark.read.schema(schema).parquet(*loaded) if loaded else spark.createDataFrame([], schema)
    region = F.regexp_extract(F.col("_metadata.file_path"), r"/region=([A-Z]{2})/", 1) if loaded else F.lit("")
    every = every.select("*", region.alias("region_code"))
    counts = every.groupBy("region_code").agg(
        F.count_if(F.col(_BROKEN).isNull()).alias("n"), F.count(_BROKEN).alias("n_broken"))
    told = spark.createDataFrame(report, "region_code string, status string, reason string").join(
        counts, "region_code", "left").select(
        "region_code", "status", F.coalesce("n", F.lit(0)).alias("rows"),
        F.coalesce("n_broken", F.lit(0)).alias("broken_rows"), "reason")
    return LoadedRegions(every.where(F.col(_BROKEN).isNull()).drop(_BROKEN), told,
                         every.where(F.col(_BROKEN).isNotNull()).select("region_code", F.col(_BROKEN).alias("record")))


def region_files(spark: SparkSession, folder: str) -> DataFrame:
    """(region_code, path) of the regional CSV files that are there."""
    found = landing_inventory(spark, folder).select("path", _region_of(F.col("path")).alias("region_code"))
    return found.where(F.col("region_code").isin(*K.LOADER_REGIONS))


def missing_regions(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in K.LOADER_REGIONS])).alias("region_code"))
    return wanted.join(region_files(spark, folder).select("region_code").distinct(), "region_code", "left_anti")


def load_all_regions(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Every supported region's CSV in one scan; the region comes from the path.

    Regions without a file are simply absent (``missing_regions`` names them).  Files must have the known header;
    ``load_regions`` takes others and sets aside what it can't read.
    """
    rows = _csv(spark, f"{folder}/*videos.csv", multi_line).withColumn(
        "region_code", _region_of(F.col("_metadata.file_path")))
    return rows.where(F.col("region_code").isin(*K.LOADER_REGIONS))


CATEGORY_DOCUMENT = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("assignable", T.BooleanType()),
        T.StructField("channelId", T.StringType())])),
])))])


def _documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON documents: one per file, or one per line with ``multi_line=False`` (splittable)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def load_category_reference(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, title) of a category document; items lacking either are dropped."""
    items = _documents(spark, path, CATEGORY_DOCUMENT, multi_line).select(F.inline("items"))
    return items.select("id", F.col("snippet.title").alias("title")).where(
        "id IS NOT NULL AND id <> '' AND title IS NOT NULL AND title <> ''")


def flatten_category_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    items = _documents(spark, path, CATEGORY_DOCUMENT, multi_line).select(F.inline("items"))
    return items.select(
        F.col("id").try_cast("int").alias("category_id"), "snippet.title", "snippet.assignable",
        F.col("snippet.channelId").alias("channel_id"))


def flatten_columns(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Every leaf of nested structs as a column named by its dotted path."""
    out = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += flatten_columns(field.dataType, f"{path}.")
        else:
            quoted = ".".join(f"`{p}`" for p in path.split("."))
            out.append(F.col(quoted).alias(path))
    return out


def items_to_rows(df: DataFrame) -> DataFrame:
    """Documents ``{items: [...]}`` to one flat row per item with dotted names."""
    items = df.select(F.inline("items"))
    return items.select(*flatten_columns(items.schema))


def json_items_to_rows(spark: SparkSession, path: str, schema: T.StructType | None = None,
                       multi_line: bool = True) -> DataFrame:
    """Landed documents flattened; without a declared schema Spark infers one."""
    reader = spark.read.option("multiLine", multi_line)
    return items_to_rows((reader.schema(schema) if schema else reader).json(path))


_S, _B = T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


VIDEO_ITEM = _struct(
    id=_S,
    snippet=_struct(title=_S, description=_S, tags=T.ArrayType(_S), categoryId=_S, channelId=_S,
                    channelTitle=_S, publishedAt=_S, thumbnails=_struct(high=_struct(url=_S))),
    statistics=_struct(viewCount=_S, likeCount=_S, commentCount=_S),
    contentDetails=_struct(duration=_S, definition=_S, caption=_S, licensedContent=_B, projection=_S),
    status=_struct(uploadStatus=_S, privacyStatus=_S),
)
VIDEO_DOCUMENT = T.StructType([T.StructField("items", T.ArrayType(VIDEO_ITEM))])


def flatten_video_documents(items: DataFrame, region: Column, as_of: Column) -> DataFrame:
    """API video items to flat, typed rows with rate and length columns.

    Missing counts are 0, missing texts empty, missing tags an empty array.
    ``as_of`` is the time of extraction.
    """
    def txt(path):
        return F.coalesce(F.col(path), F.lit(""))

    def number(path, kind="bigint"):
        return F.coalesce(F.col(path).try_cast(kind), F.lit(0).cast(kind))

    tags = F.coalesce("snippet.tags", F.array().cast("array<string>"))
    views, likes, comments = (number(f"statistics.{c}Count") for c in ("view", "like", "comment"))
    title, description = txt("snippet.title"), txt("snippet.description")
    return items.where("id IS NOT NULL").select(
        F.col("id").alias("video_id"), title.alias("title"), description.alias("description"),
        tags.alias("tags"), F.size(tags).alias("tag_count"),
        number("snippet.categoryId", "int").alias("category_id"),
        txt("snippet.channelId").alias("channel_id"), txt("snippet.channelTitle").alias("channel_title"),
        F.try_to_timestamp("snippet.publishedAt").alias("publish_date"),
        as_of.cast("timestamp").alias("trending_date"), region.alias("region_code"),
        views.alias("views"), likes.alias("likes"), comments.alias("comments"),
        txt("contentDetails.duration").alias("duration"),
        text.duration_seconds(txt("contentDetails.duration")).alias("duration_seconds"),
        txt("contentDetails.definition").alias("definition"), txt("contentDetails.caption").alias("caption"),
        txt("status.uploadStatus").alias("status"), txt("status.privacyStatus").alias("privacy_status"),
        F.coalesce("contentDetails.licensedContent", F.lit(False)).alias("license"),
        txt("contentDetails.projection").alias("projection"),
        txt("snippet.thumbnails.high.url").alias("thumbnail_url"),
        as_of.cast("timestamp").alias("extracted_at"),
        engagement.engagement_rate(likes, comments, views).alias("engagement_rate"),
        F.length(title).alias("title_length"), F.length(description).alias("description_length"),
        text.word_count(title).alias("title_word_count"),
    )


SEARCH_DOCUMENT = _struct(items=T.ArrayType(_struct(id=_struct(kind=_S, videoId=_S))))


def filter_search_hits(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Ids of the search hits that are videos."""
    hits = _documents(spark, path, SEARCH_DOCUMENT, multi_line).select(F.inline("items"))
    return hits.where(F.col("id.kind") == K.SEARCH_VIDEO_KIND).select(F.col("id.videoId").alias("video_id"))


def read_latest_batch(df: DataFrame, column: str = "batch_date") -> DataFrame:
    """Rows of the newest batch; on a table partitioned by ``column`` only that partition is read."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def landing_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and modification time of every file below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select("path", "length", "modificationTime"))


def inventory_totals(files: DataFrame, *by) -> DataFrame:
    return files.groupBy(*by).agg(
        F.count("*").alias("objects"), F.sum("length").alias("bytes"),
        F.round(F.sum("length") / 1024**3, 2).alias("gigabytes"))


def standardize_columns(df: DataFrame, categories: DataFrame | None, batch_time: Column) -> DataFrame:
    """Regional CSV rows to the fixed 21 columns.

    ``categories`` is (id, title) or None; ``batch_time`` fills trending and extraction time.
    """
    def count(c):
        return F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).cast("bigint")

    if categories is not None:
        names = categories.select(F.col("id").alias("category_id"), F.col("title").alias("category_name"))
        df = df.join(names, "category_id", "left")
    else:
        df = df.withColumn("category_name", F.lit(None).cast("string"))
    views, likes, comments = count("views"), count("likes"), count("comment_count")
    tags = F.coalesce("tags", F.lit(""))
    filled = {
        "video_id": F.col("video_id"), "title": F.col("title"), "description": F.col("description"),
        "tags": tags, "tag_count": text.tag_count(tags, "[|]"),
        "category_id": count("category_id").cast("int"), "category_name": F.col("category_name"),
        "channel_id": F.lit(""), "channel_title": F.col("channel_title"),
        "publish_date": F.try_to_timestamp("publish_time"), "trending_date": batch_time.cast("timestamp"),
        "region_code": F.col("region_code"), "views": views, "likes": likes, "comments": comments,
        "engagement_rate": engagement.engagement_rate(likes, comments, views, zero_views_as_one=True),
        "title_length": F.length("title"), "description_length": F.coalesce(F.length("description"), F.lit(0)),
        "title_word_count": text.word_count(F.col("title")), "thumbnail_url": F.col("thumbnail_link"),
        "extracted_at": batch_time.cast("timestamp"),
    }
    return df.select(*[c.alias(n) for n, c in filled.items()])
