"""The three zone schemas with their field rules.

A rule is a number or list in the field's metadata: ``min``, ``max``,
``min_length``, ``max_length``, ``pattern``, ``allowed``.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
          "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _field(name, kind, required=False, **rules):
    return T.StructField(name, _TYPES[kind], not required, rules or None)


_VIDEO_ID = _field("video_id", "string", True, min_length=1, max_length=50)
_TITLE = _field("title", "string", True, min_length=1, max_length=200)
_DESCRIPTION = _field("description", "string", max_length=5000)
_TAGS = _field("tags", "string", max_length=1000)
_CATEGORY = _field("category_id", "int", True, min=1, max=44)
_CHANNEL_ID = _field("channel_id", "string", max_length=50)
_CHANNEL = _field("channel_title", "string", True, max_length=100)
_REGION = _field("region_code", "string", True, min_length=2, max_length=2, pattern="^[A-Z]{2}$")
_COUNTS = [
    _field("views", "long", True, min=0, max=10**12),
    _field("likes", "long", True, min=0, max=10**11),
    _field("comments", "long", True, min=0, max=10**10),
]
_THUMBNAIL = _field("thumbnail_url", "string", max_length=500)

RAW = T.StructType([
    _VIDEO_ID, _TITLE, _DESCRIPTION, _TAGS, _CATEGORY, _CHANNEL_ID, _CHANNEL,
    _field("publish_date", "timestamp"), _field("trending_date", "timestamp", True), _REGION,
    *_COUNTS, _THUMBNAIL, _field("extracted_at", "timestamp"),
])

CLEANED = T.StructType([
    _VIDEO_ID, _TITLE,
    _field("description", "string", True, max_length=5000), _field("tags", "string", True, max_length=1000),
    _field("tag_count", "int", True, min=0, max=50), _CATEGORY, _field("category_name", "string"),
    _CHANNEL_ID, _CHANNEL,
    _field("publish_date", "timestamp", True), _field("trending_date", "timestamp", True), _REGION,
    *_COUNTS,
    _field("engagement_rate", "double", True, min=0, max=1),
    _field("title_length", "int", True, min=1, max=200),
    _field("description_length", "int", True, min=0, max=5000),
    _field("title_word_count", "int", True, min=1, max=100),
    _THUMBNAIL, _field("extracted_at", "timestamp", True),
    _field("has_description", "boolean", True), _field("has_tags", "boolean", True),
    _field("engagement_category", "string", True, allowed=["Low", "Medium", "High"]),
    _field("view_category", "string", True, allowed=["Low", "Medium", "High", "Viral"]),
])

ANALYTICS = T.StructType([
    _field("video_id", "string", True), _field("title", "string", True),
    _field("description", "string", True), _field("tags", "string", True),
    _field("category_id", "int", True), _field("category_name", "string"),
    _field("channel_title", "string", True), _field("publish_date", "timestamp", True),
    _field("trending_date", "timestamp", True), _field("region_code", "string", True),
    _field("views", "long", True), _field("likes", "long", True), _field("comments", "long", True),
    _field("engagement_rate", "double", True), _field("time_to_trending_hours", "double"),
    _field("publish_hour", "int", True, min=0, max=23),
    _field("publish_day_of_week", "int", True, min=1, max=7),
    _field("publish_week", "int", True, min=1, max=53),
    _field("publish_month", "int", True, min=1, max=12),
    _field("publish_year", "int", True, min=2005, max=2030),
    _field("title_length", "int", True), _field("description_length", "int", True),
    _field("tag_count", "int", True), _field("title_word_count", "int", True),
    _field("has_description", "boolean", True), _field("has_tags", "boolean", True),
    _field("engagement_category", "string", True), _field("view_category", "string", True),
    _field("nlp_predicted_category", "int"), _field("nlp_category_confidence", "double", min=0, max=1),
    _field("ml_predicted_views", "double"), _field("ml_predicted_engagement_rate", "double", min=0, max=1),
    _field("data_quality_score", "double", min=0, max=100), _field("processed_at", "timestamp", True),
])

# What the batch job reads and the regional loader writes.
JOB_INPUT = T.StructType([
    _field("video_id", "string", True), _field("title", "string", True), _field("description", "string"),
    _field("tags", "string"), _field("tag_count", "int"), _field("category_id", "int", True),
    _field("category_name", "string"), _field("channel_id", "string"),
    _field("channel_title", "string", True), _field("publish_date", "timestamp"),
    _field("trending_date", "timestamp", True), _field("region_code", "string", True),
    _field("views", "long", True), _field("likes", "long", True), _field("comments", "long", True),
    _field("engagement_rate", "double"), _field("title_length", "int"),
    _field("description_length", "int"), _field("title_word_count", "int"),
    _field("thumbnail_url", "string"), _field("extracted_at", "timestamp"),
])

SCHEMAS = {"raw": RAW, "cleaned": CLEANED, "analytics": ANALYTICS, "job_input": JOB_INPUT}
PARTITION_KEYS = {"raw": ["region_code"], "cleaned": ["region_code", "category_id"],
                  "analytics": ["region_code", "category_id", "publish_year"]}
PRIMARY_KEYS = {name: ["video_id"] for name in PARTITION_KEYS}


def schema(name: str) -> T.StructType:
    return SCHEMAS[name]


def save_schema(name: str, path: str) -> None:
    """Schema, keys and rules as a JSON document."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"name": name, "schema": SCHEMAS[name].jsonValue(),
                   "partition_keys": PARTITION_KEYS.get(name, []),
                   "primary_keys": PRIMARY_KEYS.get(name, [])}, out, indent=2)


def load_schema(path: str) -> T.StructType:
    with open(path, encoding="utf-8") as source:
        return T.StructType.fromJson(json.load(source)["schema"])
