"""Base forms against plain Python, and their way through training and prediction."""

from pyspark.sql import functions as F

from trendmill import constants as K
from trendmill.models import lemmas, nlp
from tests.test_models import videos


def plain_table(words):
    known, table = {w for w in words if w is not None}, {}
    for word in known:
        listed = K.IRREGULAR_NOUNS.get(word)
        forms = {word[:len(word) - len(end)] + base for end, base in K.NOUN_ENDINGS if word.endswith(end)} & known
        best = listed if listed in known else min(forms, key=lambda f: (len(f), f), default=word)
        if best != word:
            table[word] = best
    return table


WORDS = """cat cats class classes box boxes church churches wish wishes women woman city cities knife knives wolf wolves
leaf leaves news new feet foot bus buses buse buzz buzzes quiz glass as pass species specie unknowns wives die dies dy
men man firemen fireman series serie""".split()


def test_table_equals_plain_python(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, *WORDS[:9], None]], "token string")
    found = {r.token: r.lemma for r in lemmas.lemma_table(rows).collect()}
    assert found == plain_table([*WORDS, None])
    assert found["knives"] == "knife" and found["cities"] == "city" and "news" not in found and "unknowns" not in found
    assert lemmas.lemma_table(rows.limit(0)).count() == 0


def test_texts_keep_rows_order_and_columns(spark):
    long = ["cats", "city", "cities"] * 7000
    data = [(1, ["cats", "eat", "cats"], "a"), (1, ["cats", "eat", "cats"], "b"), (2, [], "c"), (3, None, "d"),
            (None, ["cities", None, "eat"], "e"), (4, long, "f"),
            (5, ["cities", "eat"], "g"), (6, ["cities eat"], "h")]
    df = spark.createDataFrame(data, "entries int, tokens array<string>, digest string")
    table = spark.createDataFrame([("cats", "cat"), ("cities", "city")], "token string, lemma string")
    out = lemmas.lemmatise(df, "tokens", table)
    assert out.columns == df.columns
    got = {r.digest: (r.entries, r.tokens) for r in out.collect()}
    base = {"cats": "cat", "cities": "city"}
    assert got == {c: (a, b and [base.get(t, t) for t in b]) for a, b, c in data}
    assert lemmas.lemmatise(df.limit(0), "tokens", table).count() == 0


def test_training_prediction_and_saved_model_share_the_lemmas(spark, tmp_path):
    df = videos(spark).withColumn("title", F.concat("title", F.when(F.col("category_id") == 26, F.lit(" recipes"))
                                                    .otherwise(F.lit(" consoles"))))
    model = nlp.train_text_model(df, folds=0)
    assert {tuple(r) for r in model.lemmas.collect()} >= {("recipes", "recipe"), ("consoles", "console")}
    words = model.pipeline.stages[0].vocabulary
    assert "recipe" in words and not [w for w in words if "recipes" in w.split() or "consoles" in w.split()]
    # A text of plurals alone is told by the base forms the model learnt.
    fresh = df.limit(1).withColumns({"video_id": F.lit("new"), "title": F.lit("recipes recipes consoles recipes"),
                                     "description": F.lit(""), "tags": F.lit("")})
    nlp.save_text_model(model, str(tmp_path / "m"))
    loaded = nlp.load_text_model(str(tmp_path / "m"))
    for m in (model, loaded):
        assert nlp.predict_categories(fresh, m).first().nlp_predicted_category == 26
    assert loaded.lemmas.exceptAll(model.lemmas).isEmpty()
