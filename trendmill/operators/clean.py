"""Standardising, deduplicating and repairing video rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.functions import bands, engagement, temporal, text
from trendmill.operators.enrich import presence_flags
from trendmill.operators.ranks import column_quantiles
from trendmill.session import materialise

CRITICAL = ["video_id", "title", "channel_title", "views", "likes"]
COUNTS = ["views", "likes", "comments", "tag_count"]
CAPPED = ["views", "likes", "comments"]


def drop_null_critical(df: DataFrame, columns=CRITICAL) -> DataFrame:
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def dedup_any(df: DataFrame, keys=("video_id",)) -> DataFrame:
    """One row per key, whichever arrives; prefer ``dedup_keep_last``."""
    return df.dropDuplicates(list(keys))


def dedup_keep_last(df: DataFrame, keys, order) -> DataFrame:
    """The row of each key that comes last by ``order`` (nulls come first).

    A maximum over a struct combines on the map side, so a key that owns a third
    of all rows ships one row per task; ``row_number`` would gather them all.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(*keys, "last.*").select(*df.columns)


def fill_missing_text(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "description": F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit(K.NO_DESCRIPTION)),
        "tags": F.coalesce("tags", F.lit("")),
    })


def clean_text_fields(df: DataFrame) -> DataFrame:
    """Trim and squeeze all text; drop stray symbols from titles and tags."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit(""))

    description = text.squeeze(text.strip(blank("description")))
    return df.withColumns({
        "title": text.clean_title(blank("title")),
        "description": F.when(description == "", K.NO_DESCRIPTION).otherwise(description),
        "tags": text.clean_tags(blank("tags")),
        "channel_title": text.squeeze(text.strip(blank("channel_title"))),
    })


def to_count(value: Column) -> Column:
    """Whole number from any input; what cannot be read counts as 0."""
    whole = F.coalesce(value.try_cast("bigint"), F.floor(value.try_cast("double")))
    return F.coalesce(whole, F.lit(0)).cast("bigint")


def clean_numeric_fields(df: DataFrame) -> DataFrame:
    """Unreadable and negative counts become 0; category ids are clipped into range."""
    present = [c for c in COUNTS if c in df.columns]
    df = df.withColumns({c: F.greatest(to_count(F.col(c)), F.lit(0)) for c in present})
    if "category_id" in df.columns:
        df = fix_category_id(df.withColumn("category_id", to_count(F.col("category_id"))), "clip")
    return df


def numeric_corrections(df: DataFrame) -> list[Column]:
    """Aggregates counting what ``clean_numeric_fields`` changes, one per rule."""
    low, high = K.CATEGORY_ID_RANGE
    out = [F.count_if(to_count(F.col(c)) < 0).alias(f"negative_{c}") for c in COUNTS if c in df.columns]
    if "category_id" in df.columns:
        out.append(F.count_if(~to_count(F.col("category_id")).between(low, high)).alias("invalid_category_id"))
    return out


def fix_category_id(df: DataFrame, mode: str = "reset") -> DataFrame:
    low, high = K.CATEGORY_ID_RANGE
    category = F.col("category_id")
    if mode == "reset":
        fixed = F.when((category < low) | (category > high), low).otherwise(category)
    elif mode == "clip":
        fixed = F.when(category.isNotNull(), F.greatest(F.least(category, F.lit(high)), F.lit(low)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("category_id", fixed.cast("int"))


def clean_date_fields(df: DataFrame, now: Column) -> DataFrame:
    """Read dates; missing publish dates get a fixed day, missing trending dates ``now``."""
    def read(c):
        return F.try_to_timestamp(F.col(c).cast("string"))

    out = {"publish_date": F.coalesce(read("publish_date"),
                                      F.lit(K.DEFAULT_PUBLISH_DATE).cast("timestamp")),
           "trending_date": F.coalesce(read("trending_date"), now.cast("timestamp"))}
    if "extracted_at" in df.columns:
        out["extracted_at"] = read("extracted_at")
    return df.withColumns({c: v for c, v in out.items() if c in df.columns})


def iqr_fences(df: DataFrame, columns=CAPPED, reach: float = 1.5) -> DataFrame:
    """(column, q1, q3, low, high): exact quartiles and the fences around them."""
    spread = F.col("q3") - F.col("q1")
    return column_quantiles(df, list(columns), {"q1": 0.25, "q3": 0.75}).withColumns({
        "low": F.col("q1") - reach * spread, "high": F.col("q3") + reach * spread})


def _fence_lookup(df: DataFrame, columns, reach: float) -> Column:
    """The fences as one map value, computed once as a scalar subquery."""
    entries = F.collect_list(F.struct("column", F.struct("low", "high")))
    return iqr_fences(df, columns, reach).agg(F.map_from_entries(entries)).scalar()


def cap_outliers_iqr(df: DataFrame, columns=CAPPED, reach: float = 1.5) -> DataFrame:
    fences = _fence_lookup(df, columns, reach)
    out = {}
    for c in columns:
        low = F.element_at(fences, F.lit(c)).getField("low")
        high = F.element_at(fences, F.lit(c)).getField("high")
        value = F.col(c).cast("double")
        out[c] = F.when(value < low, low).when(value > high, high).otherwise(value)
    return df.withColumns(out)


def outlier_counts(df: DataFrame, columns=CAPPED, reach: float = 1.5) -> DataFrame:
    """(column, q1, q3, low, high, outliers): rows outside the fences."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    return (  # the fences are one row per listed column
        long.join(F.broadcast(iqr_fences(df, columns, reach)), "column")
        .groupBy("column", "q1", "q3", "low", "high")
        .agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outliers"))
    )


def add_derived_fields(df: DataFrame) -> DataFrame:
    """Derived columns of the cleaner; its bands are closed on the right."""
    views = F.col("views")
    rate = engagement.engagement_rate(F.col("likes"), F.col("comments"), views)
    count = text.tag_count(F.col("tags"), "[|]")
    return df.withColumns({
        "engagement_rate": rate,
        "title_length": F.length("title"),
        "title_word_count": text.word_count(F.col("title")),
        "description_length": F.length("description"),
        "tag_count": count,
        "time_to_trending_hours": temporal.hours_between(F.col("publish_date"), F.col("trending_date")),
        "has_description": F.col("description") != K.NO_DESCRIPTION,
        "has_tags": count > 0,
        "engagement_category": bands.engagement_category(rate, right_closed=True),
        "view_category": bands.view_category(views, right_closed=True),
    })


def _repaired(df: DataFrame, keys, order, now: Column) -> DataFrame:
    """Everything before outliers are capped."""
    return (
        df.transform(dedup_keep_last, keys, order)
        .transform(clean_text_fields)
        .transform(clean_numeric_fields)
        .transform(clean_date_fields, now)
    )


def comprehensive_clean(df: DataFrame, order, now: Column, keys=("video_id",)) -> DataFrame:
    """Dedup, text, numbers, dates, outliers, derived columns, null rows - in that order.

    The fences need two passes over the repaired rows before the rows themselves
    go on, so the deduplicated rows are written once rather than shuffled thrice.
    """
    return (
        materialise(_repaired(df, keys, order, now), "repaired")
        .transform(cap_outliers_iqr)
        .transform(add_derived_fields)
        .transform(drop_null_critical)
    )


def cleaning_report(df: DataFrame, order, keys=("video_id",)) -> DataFrame:
    """One row: rows in and out, what was removed or changed, and the score."""
    unique = materialise(dedup_keep_last(df, keys, order), "unique")
    corrections = numeric_corrections(unique)
    numbers = clean_numeric_fields(unique)
    fences = _fence_lookup(numbers, CAPPED, 1.5)
    outside = F.lit(0)
    for c in CAPPED:
        fence = F.element_at(fences, F.lit(c))
        value = F.col(c)
        outside = outside + ((value < fence.getField("low")) | (value > fence.getField("high"))).cast("int")
    before = unique.agg(F.count("*").alias("unique_records"), *corrections,
                        F.count_if(F.col("video_id").isNull()).alias("nulls_removed"))
    names = [c for c in before.columns if c.startswith(("negative_", "invalid_"))]
    corrected = F.lit(0)
    for n in names:
        corrected = corrected + F.col(n)
    initial = df.agg(F.count("*")).scalar()
    capped = numbers.agg(F.sum(outside)).scalar()
    report = before.select(
        initial.alias("initial_records"),
        (F.col("unique_records") - F.col("nulls_removed")).alias("final_records"),
        (initial - F.col("unique_records")).alias("duplicates_removed"),
        "nulls_removed",
        corrected.cast("bigint").alias("invalid_values_corrected"),
        F.coalesce(capped, F.lit(0)).cast("bigint").alias("outliers_handled"))
    issues = (F.col("duplicates_removed") + F.col("nulls_removed")
              + F.col("invalid_values_corrected") + F.col("outliers_handled"))
    score = F.round(F.greatest(F.lit(0.0), 100.0 - issues * 100.0 / F.col("initial_records")), 2)
    return report.withColumn(
        "data_quality_score", F.when(F.col("initial_records") == 0, 0.0).otherwise(score))


def batch_clean(df: DataFrame, order, keys=("video_id",)) -> DataFrame:
    """The batch job's cleaning: critical nulls, dedup, text, numbers, category reset.

    The survivor of a duplicate is defined by ``order`` rather than arbitrary.
    """
    numbers = ["views", "likes", "comments", "tag_count", "title_length",
               "description_length", "title_word_count"]
    df = drop_null_critical(df).transform(dedup_keep_last, keys, order).transform(fill_missing_text)
    df = df.withColumns({
        "title": text.squeeze(F.col("title")),
        "description": text.squeeze(F.col("description")),
        **{c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in numbers if c in df.columns},
    })
    return fix_category_id(df, "reset")


def batch_transform(df: DataFrame) -> DataFrame:
    """The batch job's derived columns: day-based time to trending, 1 = Sunday weekdays."""
    publish, trending = F.col("publish_date"), F.col("trending_date")
    rate = engagement.engagement_rate(F.col("likes"), F.col("comments"), F.col("views"))
    calendar = temporal.calendar(publish)
    keep = ["publish_hour", "publish_week", "publish_month", "publish_year"]
    return df.withColumns({
        "engagement_rate": rate,
        "time_to_trending_hours": temporal.hours_between(publish, trending, "days"),
        **{k: calendar[k] for k in keep},
        "publish_day_of_week": F.dayofweek(publish),
        "title_word_count": text.word_count(F.col("title")),
        "title_length": F.length("title"),
        "description_length": F.length("description"),
        "tag_count": text.tag_count(F.col("tags"), "[|,]"),
        **presence_flags(F.col("description"), F.col("tags")),
        "engagement_category": bands.engagement_category(rate),
        "view_category": bands.view_category(F.col("views")),
    })
