"""M*: text and feature preparation, training, scoring.

Preparation has SQL twins.  Training has none: forests and boosting are compared
by schema and figures.  Training queries run over the whole tables, the engagement and age
models at the library's default trees, rounds, depth and folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.adapters import doc_videos, videos
from trendmill.models import age, engagement, features, lemmas, nlp, text
from trendmill.models.split import mark_train
from trendmill.operators import audience
from trendmill.operators.enrich import analytics_columns
from trendmill.plans.registry import query
from trendmill.plans.sqltext import (
    COMBINED, RATE, band, hours, in_list, ratio, tag_count, tokens, videos_sql, with_tables, words,
)
from trendmill.session import materialise, scratch_path, spread


TOKENS_SQL = f"doc_tokens AS (SELECT doc_id, category_id, {tokens(COMBINED)} AS tokens FROM doc_videos)"


@query("preprocess_text", with_tables(
    f"SELECT doc_id, array_to_string({tokens('description')}, ' ') AS clean_text FROM doc_videos", "docs"))
def preprocess_text(spark, sf):
    return doc_videos(spark, sf).select("doc_id", text.preprocess_text(F.col("description")).alias("clean_text"))


@query("combine_text", with_tables(
    "SELECT doc_id, array_to_string(tokens, ' ') AS combined FROM doc_tokens", "docs", TOKENS_SQL))
def combine_text(spark, sf):
    return text.combine_text(doc_videos(spark, sf)).select("doc_id", F.concat_ws(" ", "tokens").alias("combined"))


def _doc_tokens(spark, sf):
    """(doc_id, tokens), read off the texts once by all tasks."""
    return materialise(text.combine_text(spread(doc_videos(spark, sf), "doc_id")).select("doc_id", "tokens"), "doc-tokens")


def _lemma_ctes(source: str) -> str:
    """The lemma table of the tokens in ``source`` and ``lemma_tokens``, its texts with lemmas in place."""
    irregular = ", ".join(f"('{t}', '{b}')" for t, b in K.IRREGULAR_NOUNS.items())
    rules = " UNION ALL ".join(
        f"SELECT token, 1 AS rank, left(token, length(token) - {len(e)}) || '{b}' AS lemma FROM known WHERE token LIKE '%{e}'"
        for e, b in K.NOUN_ENDINGS)
    return f"""singles AS (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {source}),
known AS (SELECT DISTINCT token FROM singles),
forms AS (SELECT token, 0 AS rank, base AS lemma FROM known JOIN (VALUES {irregular}) irregular(token, base) USING (token)
  UNION ALL {rules}),
lemma_table AS (SELECT token, lemma FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.token ORDER BY rank, length(f.lemma), f.lemma) AS place
  FROM forms f JOIN known k ON k.token = f.lemma) WHERE place = 1),
lemma_tokens AS (SELECT d.doc_id, any_value(d.category_id) AS category_id,
  coalesce(list(coalesce(lemma, token) ORDER BY pos) FILTER (WHERE token IS NOT NULL), []) AS tokens
  FROM {source} d LEFT JOIN singles USING (doc_id) LEFT JOIN lemma_table USING (token) GROUP BY d.doc_id)"""


@query("lemmatise_text", with_tables(
    "SELECT doc_id, array_to_string(tokens, ' ') AS lemmas FROM lemma_tokens", "docs", TOKENS_SQL, _lemma_ctes("doc_tokens")))
def lemmatise_text(spark, sf):
    """Base forms by ending and exception, among the words of the texts themselves."""
    rows = _doc_tokens(spark, sf)
    done = lemmas.lemmatise(rows, "tokens", materialise(lemmas.fit_lemmas(rows), "lemmas"))
    return done.select("doc_id", F.concat_ws(" ", "tokens").alias("lemmas"))


_KNOWN_DOCS = f"known_docs AS (SELECT * FROM doc_tokens WHERE category_id IN {in_list(K.CATEGORY_TITLES)})"
_TRAINING = """training AS (
  SELECT doc_id, category_id, tokens, dense_rank() OVER (ORDER BY category_id) - 1 AS label FROM lemma_tokens
  WHERE length(array_to_string(tokens, ' ')) > 10)"""


@query("nlp_training_set", with_tables("""
SELECT doc_id, category_id, CAST(label AS INTEGER) AS label, CAST(len(tokens) AS INTEGER) AS n_tokens,
  array_to_string(tokens, ' ') AS clean_text FROM training""",
    "docs", TOKENS_SQL, _KNOWN_DOCS, _lemma_ctes("known_docs"), _TRAINING))
def nlp_training_set(spark, sf):
    """With the lemmatised text that training reads."""
    return nlp.training_set(doc_videos(spark, sf)).select(
        "doc_id", "category_id", "label", F.size("tokens").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("clean_text"))


@query("stratified_split", videos_sql("""
SELECT video_id, category_id, row_number() OVER (PARTITION BY category_id
    ORDER BY CAST('0x' || substr(md5(video_id || '#42'), 1, 12) AS BIGINT), video_id)
  <= greatest(round(count(*) OVER (PARTITION BY category_id) * 0.8), 1) AS is_train FROM videos"""))
def stratified_split(spark, sf):
    return mark_train(videos(spark, sf), "video_id", "category_id").select("video_id", "category_id", "is_train")


@query("tfidf_vectors", with_tables("""
SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
FROM (SELECT doc_id, term, tf * idf AS raw FROM counted JOIN vocabulary USING (term))""", "docs", TOKENS_SQL, """
counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(tokens) AS term FROM doc_tokens
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(tokens)),
      lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM doc_tokens) GROUP BY 1, 2),
vocabulary AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM doc_tokens)) / (1 + count(*))) + 1 AS idf FROM counted GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM doc_tokens)
  ORDER BY sum(tf) DESC, term LIMIT 10000)"""), doubles="weight")
def tfidf_vectors(spark, sf):
    return text.tfidf_weights(_doc_tokens(spark, sf), "doc_id")


_TAGS = (r"list_filter(list_transform(regexp_split_to_array(tags, '[|,;]'), "
         r"lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '' AND t <> '[none]')")
FEATURES_SQL = f"""filled AS (
  SELECT * REPLACE (coalesce(description, '') AS description, coalesce(tags, '') AS tags,
    coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments) FROM videos),
features AS (
  SELECT video_id, hour(publish_date) AS publish_hour, isodow(publish_date) - 1 AS publish_day_of_week,
    month(publish_date) AS publish_month, year(publish_date) AS publish_year,
    coalesce({hours('publish_date', 'trending_date')}, 0) AS time_to_trending_hours,
    length(title) AS title_length, len({words('title')}) AS title_word_count,
    length(description) AS description_length, len({words('description')}) AS description_word_count,
    {tag_count('tags')} AS tag_count,
    CASE WHEN len({_TAGS}) > 0 THEN list_sum(list_transform({_TAGS}, lambda t: length(t))) / len({_TAGS})
      ELSE 0 END AS avg_tag_length,
    len(list_distinct(list_transform({_TAGS}, lambda t: lower(t)))) AS unique_tag_count,
    length(title) + length(description) + length(tags) AS total_text_length,
    {ratio('likes', 'views')} AS like_rate, {ratio('comments', 'views')} AS comment_rate,
    {ratio('likes', 'comments', 'likes')} AS like_to_comment_ratio,
    ln(1 + views) AS log_views, ln(1 + likes) AS log_likes, ln(1 + comments) AS log_comments,
    0.5 * ln(1 + likes) + 0.3 * ln(1 + comments) + 0.2 * {RATE} AS engagement_score,
    length(channel_title) AS channel_name_length, len({words('channel_title')}) AS channel_word_count,
    CAST(category_id AS VARCHAR) AS category_id, region_code, {band('views', *K.VIEW_BANDS)} AS view_category,
    {band(RATE, *K.ENGAGEMENT_BANDS)} AS engagement_category,
    coalesce({band(hours('publish_date', 'trending_date'), *K.SPEED_BANDS, closed='<=')}, 'Unknown') AS trending_speed,
    region_code || '_' || category_id AS region_category_combo
  FROM filled)"""


@query("build_features", videos_sql(
    f"SELECT video_id, {', '.join(K.NUMERIC_FEATURES + K.CATEGORICAL_FEATURES)} FROM features", FEATURES_SQL),
       doubles=" ".join(K.NUMERIC_FEATURES))
def all_features(spark, sf):
    """All groups in order, shown as the columns the models read."""
    return features.model_columns(videos(spark, sf)).select(
        "video_id", *K.NUMERIC_FEATURES, *K.CATEGORICAL_FEATURES)


_SCALED = videos_sql("SELECT video_id, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0) AS {c}"
    for c in K.NUMERIC_FEATURES) + " FROM features", FEATURES_SQL)


@query("feature_matrix", _SCALED, doubles=" ".join(K.NUMERIC_FEATURES))
def feature_matrix(spark, sf):
    """The scaled part of the matrix, column by column."""
    matrix, _ = features.feature_matrix(videos(spark, sf))
    return features.scaled_columns(matrix)


@query("save_load_transformers", _SCALED, doubles=" ".join(K.NUMERIC_FEATURES))
def save_load_transformers(spark, sf):
    """Transformers fitted, saved, loaded and applied again."""
    _, model = features.feature_matrix(videos(spark, sf))
    path = scratch_path(spark, "transformers")
    features.save_transformers(model, path)
    matrix, _ = features.feature_matrix(videos(spark, sf), features.load_transformers(spark, path))
    return features.scaled_columns(matrix)


@query("feature_catalog")
def feature_catalog(spark, sf):
    matrix, _ = features.feature_matrix(videos(spark, sf))
    return features.feature_catalog(matrix)


def _regression_input(spark, sf):
    return analytics_columns(videos(spark, sf)).select(
        "video_id", "title", "category_id", "views", "likes", "comments", "engagement_rate", "like_rate",
        "title_length", "tag_count", "publish_hour", "time_to_trending_hours")


@query("engagement_training_set", videos_sql(f"""
SELECT video_id, category_id, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments,
  length(title) AS title_length, {tag_count('tags')} AS tag_count, hour(publish_date) AS publish_hour,
  coalesce({hours('publish_date', 'trending_date')}, 0) AS time_to_trending_hours,
  coalesce({ratio('likes', 'comments', 'likes')}, 0) AS like_to_comment_ratio,
  ln(1 + views) AS log_target, coalesce({RATE}, 0) AS rate_target FROM videos WHERE views > 0"""),
       doubles="category_id likes comments title_length tag_count publish_hour time_to_trending_hours "
               "like_to_comment_ratio log_target rate_target")
def engagement_training_set(spark, sf):
    """Rates made from the targets are left out."""
    df = analytics_columns(videos(spark, sf)).select(
        "video_id", "title", "category_id", "views", "likes", "comments", "engagement_rate", "like_rate",
        "title_length", "tag_count", "publish_hour", "time_to_trending_hours", "like_to_comment_ratio")
    return engagement.training_set(df)[0]


def _text_query(kind: str):
    """Figures of one text classifier."""
    @query(f"nlp_train_{kind}")
    def run(spark, sf):
        df = doc_videos(spark, sf)
        model = nlp.train_text_model(df, kind)
        return nlp.metrics_frame(df, kind, model.metrics)

    return run


_text_query("naive_bayes")
_text_query("svm")
_text_query("random_forest")


@query("nlp_feature_importance")
def nlp_feature_importance(spark, sf):
    df = doc_videos(spark, sf)
    return nlp.feature_importance(df, nlp.train_text_model(df, folds=0))


@query("nlp_predict")
def nlp_predict(spark, sf):
    df = doc_videos(spark, sf)
    scored = nlp.predict_categories(spread(df, "doc_id"), nlp.train_text_model(df, folds=0))
    return scored.select("video_id", "category_id", "nlp_predicted_category", "nlp_category_confidence")


@query("save_load_nlp_model")
def save_load_nlp_model(spark, sf):
    df, path = doc_videos(spark, sf), scratch_path(spark, "nlp-model")
    nlp.save_text_model(nlp.train_text_model(df, folds=0), path)
    scored = nlp.predict_categories(spread(df, "doc_id"), nlp.load_text_model(path))
    return scored.select("video_id", "nlp_predicted_category", "nlp_category_confidence")


def _figures(spark, df, model):
    return nlp.metrics_frame(df, f"{model.target}_{model.kind}", model.metrics)


@query("train_random_forest")
def train_random_forest(spark, sf):
    df = _regression_input(spark, sf)
    rows, names = engagement.training_set(df)
    return _figures(spark, df, engagement.fit_once(
        rows, names, "views", engagement.random_forest()))


@query("train_gradient_boosting")
def train_gradient_boosting(spark, sf):
    df = _regression_input(spark, sf)
    rows, names = engagement.training_set(df)
    return _figures(spark, df, engagement.fit_once(
        rows, names, "views", engagement.gradient_boosting()))


@query("fit_and_score")
def fit_and_score(spark, sf):
    """With cross-validation."""
    df = _regression_input(spark, sf)
    rows, names = engagement.training_set(df)
    return _figures(spark, df, engagement.fit_once(
        rows, names, "engagement_rate", engagement.random_forest()))


@query("train_models")
def train_models(spark, sf):
    df = _regression_input(spark, sf)
    return engagement.training_summary(df, engagement.train_models(df))


@query("feature_importance_summary")
def feature_importance_summary(spark, sf):
    df = _regression_input(spark, sf)
    return engagement.feature_importance(df, engagement.train_models(df))


@query("predict_engagement")
def predict_engagement(spark, sf):
    df = _regression_input(spark, sf)
    scored = engagement.predict_engagement(df, engagement.best_models(engagement.train_models(df)))
    return scored.select("video_id", "views", "ml_predicted_views", "ml_predicted_engagement_rate")


@query("save_load_engagement_models")
def save_load_engagement_models(spark, sf):
    df, path = _regression_input(spark, sf), scratch_path(spark, "engagement-models")
    engagement.save_models(engagement.best_models(engagement.train_models(df)), path)
    scored = engagement.predict_engagement(df, engagement.load_models(path))
    return scored.select("video_id", "ml_predicted_views", "ml_predicted_engagement_rate")


def _people(spark, sf):
    return audience.audience_table(videos(spark, sf))


@query("age_train")
def age_train(spark, sf):
    people = _people(spark, sf)
    _, figures = age.train_age_model(people)
    return nlp.metrics_frame(people, "age_random_forest", figures)


@query("age_train_boosting")
def age_train_boosting(spark, sf):
    people = _people(spark, sf)
    _, figures = age.train_age_model(people, "gradient_boosting")
    return nlp.metrics_frame(people, "age_gradient_boosting", figures)


@query("age_feature_importance")
def age_feature_importance(spark, sf):
    people = _people(spark, sf)
    model, _ = age.train_age_model(people)
    return age.importance(people, model)


@query("age_predict")
def age_predict(spark, sf):
    people = _people(spark, sf)
    model, _ = age.train_age_model(people)
    return age.predict_age_groups(people, model).select(
        "video_id", "age_group", "predicted_age_group_id", "predicted_age_group")
