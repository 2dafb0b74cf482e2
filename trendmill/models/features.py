"""The model feature matrix."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.operators.enrich import build_features


def model_columns(df: DataFrame) -> DataFrame:
    """The feature groups with missing numbers as 0 and missing labels as ``Unknown``."""
    built = build_features(df)
    return built.withColumns({
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in K.NUMERIC_FEATURES},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in K.CATEGORICAL_FEATURES},
    })


def matrix_pipeline() -> Pipeline:
    """Scaled numbers next to one-hot labels; labels not seen in fitting get their own slot."""
    indexed = [f"{c}_index" for c in K.CATEGORICAL_FEATURES]
    hot = [f"{c}_hot" for c in K.CATEGORICAL_FEATURES]
    return Pipeline(stages=[
        VectorAssembler(inputCols=K.NUMERIC_FEATURES, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=K.CATEGORICAL_FEATURES, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ])


def feature_matrix(df: DataFrame, model: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Rows with ``features``; fits the transformers unless given."""
    columns = model_columns(df)
    model = model or matrix_pipeline().fit(columns)
    return model.transform(columns), model


def scaled_columns(matrix: DataFrame, key: str = "video_id") -> DataFrame:
    """The scaled numbers back as columns."""
    cells = vector_to_array("scaled")
    return matrix.select(key, *[cells[i].alias(c) for i, c in enumerate(K.NUMERIC_FEATURES)])


def feature_catalog(matrix: DataFrame) -> DataFrame:
    """(position, feature, kind) for every slot of the matrix, and how many rows use it."""
    groups = matrix.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in groups.values() for a in kind)
    numbers = len(K.NUMERIC_FEATURES)

    def kind(position, name):
        if "_combo" in name or "_by_" in name:
            return "interaction"
        return "numeric" if position < numbers else "categorical"

    def label(position, name):
        return K.NUMERIC_FEATURES[position] if position < numbers else name

    named = matrix.sparkSession.createDataFrame(
        [(p, label(p, n), kind(p, n)) for p, n in slots], "position int, feature string, kind string")
    # One vector of counts for the whole matrix: a row per slot, not per cell.
    used = matrix.agg(Summarizer.numNonZeros(F.col("features")).alias("n")).select(
        F.posexplode(vector_to_array("n")).alias("position", "rows"))
    return named.join(used, "position", "left").withColumn("rows", F.col("rows").cast("bigint"))


def save_transformers(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_transformers(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
