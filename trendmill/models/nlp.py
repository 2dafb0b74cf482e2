"""Text categorisation: training, scoring, saving."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce
from statistics import fmean, pstdev

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.models.calibrate import Sigmoids, calibrated, platt_sigmoids
from trendmill.models.lemmas import fit_lemmas, lemmatise
from trendmill.models.split import mark_train, with_folds
from trendmill.models.store import TEXTS_PER_TASK, fit_side_by_side, train_tasks
from trendmill.models.text import combine_text, fit_tfidf, fold_vocabularies, has_text, terms
from trendmill.operators.evaluate import classification_metrics
from trendmill.session import materialise, spread


@dataclass
class TextModel:
    kind: str
    pipeline: PipelineModel
    metrics: dict = field(default_factory=dict)
    sigmoids: Sigmoids = field(default_factory=list)
    lemmas: DataFrame | None = None


def known_tokens(df: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows with a known category, with ``tokens`` in place of the texts.

    Reading tokens off a text costs far more than its bytes tell, so the rows are dealt over all tasks first, and the
    tokens are kept in the shared folder for the passes to come.
    """
    known = df.where(F.col("category_id").isin(*K.CATEGORY_TITLES))
    return materialise(combine_text(spread(known, key)).drop("title", "description", "tags"), "tokens")


def training_set(df: DataFrame, lemmas: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """Rows with a known category and enough text, with lemmatised ``tokens`` and a ``label`` from 0.

    ``df`` holds texts or is the result of ``known_tokens``.  Lemmas see words, never labels.
    """
    known = df if "tokens" in df.columns else known_tokens(df, key)
    lemmas = materialise(fit_lemmas(known), "lemmas") if lemmas is None else lemmas
    rows = materialise(lemmatise(known, "tokens", lemmas).where(has_text(F.col("tokens"))), "lemma-tokens")
    # At most fifteen categories, in ascending order.
    labels = known_labels(rows)
    return rows.withColumn("label", (F.array_position(labels, F.col("category_id")) - 1).cast("int"))


def known_labels(rows: DataFrame):
    return rows.agg(F.array_sort(F.collect_set("category_id"))).scalar()


def classifier(kind: str, rows: int, trees: int = 100, depth: int = 20, iterations: int = 100):
    """The three classifiers; the linear margin's C = 1 is 1/n in Spark's penalty."""
    if kind == "naive_bayes":
        return NaiveBayes(smoothing=0.1, modelType="multinomial")
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(regParam=1.0 / max(rows, 1), maxIter=iterations, standardization=False), parallelism=4)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True)
    raise ValueError(f"Unsupported classifier type: {kind}")


def fit_stages(train: DataFrame, learner, known: DataFrame | None = None) -> list:
    """Vocabulary, weights and learner, all fitted on ``train`` alone; ``known`` is its vocabulary, if counted already."""
    stages = fit_tfidf(train, known=known)
    inputs = PipelineModel(stages).transform(train).select("features", "label")
    if isinstance(learner, NaiveBayes):  # one aggregate
        return [*stages, learner.fit(inputs)]
    # Iterative fits read this frame many times, in as many tasks as its rows fill.  They keep blocks or nodes of their own in
    # memory, so the frame itself stays on disk.
    inputs = inputs.coalesce(train_tasks(train.count(), TEXTS_PER_TASK)).persist(StorageLevel.DISK_ONLY)
    try:
        return [*stages, learner.fit(inputs)]
    finally:
        inputs.unpersist()


def train_text_model(df: DataFrame, kind: str = "naive_bayes", folds: int = 5, key: str = "video_id",
                     **size) -> TextModel:
    """Stratified 80/20 split, cross-validated accuracy on the training side, figures on the test side.

    Each fold learns its own vocabulary and weights.  ``folds=0`` skips the cross-validation.
    Lemmas are learnt once from all texts and kept with the model.
    A margin classifier gets its probabilities from sigmoids fitted to the margins of the folds held out.
    """
    tokens = known_tokens(df.select(key, "title", "description", "tags", "category_id"), key)
    lemmas = materialise(fit_lemmas(tokens), "lemmas")
    rows = with_folds(mark_train(training_set(tokens, lemmas), key, "category_id", few=True), key, max(folds, 1))
    # Tokens are kept in the shared folder, not terms in the executors' memory: these are three times as large and soon made.
    rows = materialise(rows, "folded-tokens").withColumn("terms", terms(F.col("tokens")))
    sizes = {r["is_train"]: r["n"] for r in rows.groupBy("is_train").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) < K.MIN_TRAINING_ROWS:
        raise ValueError(f"Insufficient training data: {sum(sizes.values())} samples")
    # At most fifteen labels.
    labels = [str(r[0]) for r in rows.select("category_id").distinct().orderBy("category_id").collect()]
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    learner = classifier(kind, sizes.get(True, 0), **size)
    vocabulary = fold_vocabularies(train, max(folds, 1))
    cross, sigmoids = {}, []

    def fit(fold):
        return fit_stages(train if fold is None else train.where(F.col("fold") != fold), learner.copy(), vocabulary(fold))

    def held_out(fold):
        # The folds' scores are kept as rows, their models are not.
        scored = PipelineModel(fit(fold)).transform(train.where(F.col("fold") == fold))
        return materialise(scored.select("label", "prediction", vector_to_array("rawPrediction").alias("margins")), "held-out")

    stages, *held = fit_side_by_side([partial(fit, None), *(partial(held_out, k) for k in range(folds if folds > 1 else 0))])
    if held:
        scores = [accuracy.evaluate(part) for part in held]
        if kind == "svm":
            margins = reduce(DataFrame.unionByName, held)
            sigmoids = platt_sigmoids(margins, "label", F.col("margins"), len(labels))
        cross = {"cv_mean_accuracy": fmean(scores), "cv_std_accuracy": pstdev(scores)}
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)
    model = TextModel(kind, PipelineModel([*stages, back]), sigmoids=sigmoids, lemmas=lemmas)
    scored = model.pipeline.transform(test).withColumn("predicted", F.col("predicted_label").cast("int"))
    figures = classification_metrics(scored, "category_id", "predicted").first().asDict()
    model.metrics = {
        **figures, **cross,
        "training_samples": sizes.get(True, 0), "test_samples": sizes.get(False, 0),
        "meets_threshold": (figures["accuracy"] or 0.0) >= K.NLP_ACCURACY_GATE}
    return model


def class_probabilities(scored: DataFrame, sigmoids: Sigmoids = ()):
    """Probabilities by class as an array; margins go through their sigmoids, or, without any, through a softmax."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    margins = vector_to_array("rawPrediction")
    if sigmoids:
        return calibrated(margins, sigmoids)
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda acc, m: acc + F.exp(m - top))
    return F.transform(margins, lambda m: F.exp(m - top) / total)


def _confidence(scored: DataFrame, sigmoids: Sigmoids):
    return F.array_max(class_probabilities(scored, sigmoids))


def predict_categories(df: DataFrame, model: TextModel | PipelineModel) -> DataFrame:
    """Adds the predicted category and its confidence; rows without enough text get -1 and 0."""
    if not isinstance(model, TextModel):
        model = TextModel("", model)
    pipeline, sigmoids = model.pipeline, model.sigmoids
    keep = df.columns
    rows = combine_text(df)
    if model.lemmas is not None:
        rows = lemmatise(rows, "tokens", model.lemmas)
    scored = pipeline.transform(rows.withColumn("terms", terms(F.col("tokens"))))
    usable = has_text(F.col("tokens"))
    return scored.select(
        *keep,
        F.when(usable, F.col("predicted_label").cast("int")).otherwise(-1).alias("nlp_predicted_category"),
        F.when(usable, _confidence(scored, sigmoids)).otherwise(0.0).alias("nlp_category_confidence"))


def feature_importance(df: DataFrame, model: TextModel, top: int = 20) -> DataFrame:
    """Terms with the largest mean absolute weight, or tree importance.

    The model's own arrays (classes times vocabulary) become a small frame.
    """
    vocabulary = model.pipeline.stages[0].vocabulary
    fitted = model.pipeline.stages[-2]
    if hasattr(fitted, "theta"):
        scores = abs(fitted.theta.toArray()).mean(axis=0)
    elif hasattr(fitted, "models"):
        scores = sum(abs(m.coefficients.toArray()) for m in fitted.models) / len(fitted.models)
    else:
        scores = fitted.featureImportances.toArray()
    rows = [(term, float(s)) for term, s in zip(vocabulary, scores)]
    return df.sparkSession.createDataFrame(rows, "term string, importance double").orderBy(
        F.desc("importance"), "term").limit(top)


def save_text_model(model: TextModel, path: str) -> None:
    """The pipeline and, beside it, tables of its sigmoids and lemmas."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    rows = [(model.kind, i, float(a), float(b)) for i, (a, b) in enumerate(model.sigmoids)] or [(model.kind, None, None, None)]
    spark.createDataFrame(rows, "kind string, place int, slope double, offset double").write.mode("overwrite").parquet(
        f"{path}/sigmoids")
    lemmas = model.lemmas if model.lemmas is not None else spark.createDataFrame([], "token string, lemma string")
    lemmas.write.mode("overwrite").parquet(f"{path}/lemmas")


def load_text_model(path: str) -> TextModel:
    spark = SparkSession.active()
    rows = spark.read.parquet(f"{path}/sigmoids").orderBy("place").collect()  # one row per class
    sigmoids = [(r["slope"], r["offset"]) for r in rows if r["place"] is not None]
    return TextModel(rows[0]["kind"], PipelineModel.load(f"{path}/pipeline"), sigmoids=sigmoids,
                     lemmas=spark.read.parquet(f"{path}/lemmas"))


def metrics_frame(df: DataFrame, name: str, metrics: dict) -> DataFrame:
    """A model's figures as one row."""
    values = {k: (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
              for k, v in metrics.items()}
    return df.sparkSession.range(1).select(
        F.lit(name).alias("model"), *[F.lit(v).alias(k) for k, v in values.items()])
