"""Trained models. Naive Bayes has a closed form and so has SQL; solvers iterate, and tests check what they learn."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bayes, models
from ..operators.keyed import union_all
from ..operators.metrics import evaluate
from ..operators.ranking import stratified_kfold, stratified_split
from ..session import materialize
from . import sqltext as st
from .ranking_queries import SPLIT_SQL
from .registry import query
from .tables import LABELLED_SQL, labelled, table
from .text_queries import DEMO_PATTERNS, DEMO_SLANG, DEMO_STOPWORDS


# Solver steps of the registered queries: the operators' own, which are the reference's.
STEPS = models.MAX_ITER


def folded_features(spark, sf, *keep):
    df = labelled(spark, sf).select(
        "comment_id", "label_id", *keep, tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"))
    # Solvers run a job per step: small tables are best in few partitions, large ones are split.
    return materialize(stratified_split(df, "comment_id", "label_id").hint("rebalance"), "folds", "fold")


def train_test(folded):
    train = models.nonempty(folded.filter("fold <> 'test'"), "feature")
    return train, folded.filter("fold = 'test'")


def test_table(predicted):
    return predicted.select("comment_id", "label_id", F.col("prediction").cast("int").alias("predicted"))


@query("svm_grid_search", "M13 M26")
def svm_grid_search(spark, sf):
    return models.grid_search(folded_features(spark, sf), "comment_id", "feature", "label_id", max_iter=STEPS)


@query("svm_test_predictions", "M9 M13 M16 M24 P2 F4 F6")
def svm_test_predictions(spark, sf):
    folded = folded_features(spark, sf)
    grid = models.grid_search(folded, "comment_id", "feature", "label_id", max_iter=STEPS)
    _, predicted = models.refit_best(folded, "comment_id", "feature", "label_id", grid, max_iter=STEPS)
    return models.with_margin(predicted).select("comment_id", "label_id", F.col("prediction").cast("int").alias("predicted"), "margin")


@query("logistic_test_predictions", "M10")
def logistic_test_predictions(spark, sf):
    _, predicted = models.fit_test(
        folded_features(spark, sf), "comment_id", "feature", "label_id", 0.01, max_iter=STEPS, hinge=False)
    return test_table(predicted)


CLASSES = range(3)
FEATURE_SQL = f"{LABELLED_SQL}, texts AS (SELECT comment_id, label_id, {st.feature_words('text', DEMO_SLANG, DEMO_STOPWORDS)} AS ws FROM labelled)"
FILLED_SQL = "members AS (SELECT comment_id, label_id, ws FROM texts WHERE len(ws) > 0)"


def held_out_sql(folded: str, folds: str, select: str) -> str:
    """Naive Bayes for each held-out fold ``k`` of ``folds``, from the rows of ``folded`` (with ``kfold``)."""
    return f"""WITH {folded},
ks(k) AS (VALUES {folds}),
sizes AS (SELECT k, count(*) AS n FROM rows JOIN ks ON kfold <> k GROUP BY k),
terms AS (SELECT comment_id, label_id, kfold, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM rows),
tf AS (SELECT comment_id, label_id, kfold, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT k, term, count(*) AS df FROM tf JOIN ks ON kfold <> k GROUP BY ALL HAVING count(*) >= 2),
raw AS (SELECT k, comment_id, label_id, kfold, tf.term, (1 + ln(tf)) * ln((n + 1) / (df + 1)) AS raw
        FROM tf JOIN df ON df.term = tf.term JOIN sizes USING (k)),
norms AS (SELECT k, comment_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY ALL),
x AS (SELECT raw.*, CASE WHEN norm > 0 THEN raw / norm ELSE 0 END AS x FROM raw JOIN norms USING (k, comment_id)),
sums AS (SELECT k, term, c, sum(CASE WHEN label_id <> c THEN x ELSE 0 END) AS other
         FROM x, range(3) classes(c) WHERE kfold <> k GROUP BY ALL),
totals AS (SELECT k, c, sum(other + 1) AS total FROM sums GROUP BY ALL),
model AS (SELECT k, term, c, ln(total) - ln(other + 1) AS weight FROM sums JOIN totals USING (k, c)),
scores AS (SELECT comment_id, c, sum(x * weight) AS score FROM x JOIN model USING (k, term) WHERE kfold = k GROUP BY ALL),
best AS (SELECT comment_id, c FROM scores QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY score DESC, c) = 1)
{select}"""


TEST_SQL = f"""{FEATURE_SQL}, members AS (SELECT comment_id, label_id FROM texts), {SPLIT_SQL},
rows AS (SELECT comment_id, folded.label_id, ws, CASE WHEN fold = 'test' THEN 0 ELSE 1 END AS kfold
         FROM folded JOIN texts USING (comment_id) WHERE fold = 'test' OR len(ws) > 0)"""
KFOLD_SQL = f"""{FEATURE_SQL}, {FILLED_SQL},
r AS (SELECT comment_id, label_id, ws, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS r,
      count(*) OVER (PARTITION BY label_id) AS n FROM members),
rows AS (SELECT comment_id, label_id, ws, CASE WHEN r <= n // 5 THEN 0 WHEN r <= n * 2 // 5 THEN 1 WHEN r <= n * 3 // 5 THEN 2
  WHEN r <= n * 4 // 5 THEN 3 ELSE 4 END AS kfold FROM r)"""


def test_fold(folded):
    """Words and word pairs of all rows; fold 0 is the test fold, training rows have words."""
    words = tx.tokens("feature")
    rows = folded.select("comment_id", "label_id", words.alias("words"), F.when(F.col("fold") == "test", 0).otherwise(1).alias("kfold"))
    rows = materialize(rows, "words")  # the terms are read twice, texts are split once
    rows = rows.filter((F.col("kfold") == 0) | (F.size("words") > 0))
    return rows.select("comment_id", "label_id", "kfold", tx.word_ngrams(F.col("words"), 2).alias("terms"))


@query("naive_bayes_test_predictions", "M11 M1 M5", held_out_sql(TEST_SQL, "(0)",
    "SELECT comment_id, label_id, CAST(coalesce(c, 0) AS INTEGER) AS predicted FROM rows LEFT JOIN best USING (comment_id) WHERE kfold = 0"))
def naive_bayes_test_predictions(spark, sf):
    """The test fold by complement naive Bayes in closed form."""
    rows = test_fold(folded_features(spark, sf))
    return bayes.held_out_predictions(rows, "comment_id", "label_id", "kfold", "terms", [0], CLASSES, 2).drop("kfold")


@query("naive_bayes_weights", "M11 M1 M3 M5", held_out_sql(TEST_SQL, "(0)",
    "SELECT CAST(c AS INTEGER) AS label_id, term, round(weight, 6) AS weight FROM model"))
def naive_bayes_weights(spark, sf):
    rows = test_fold(folded_features(spark, sf))
    weights = bayes.naive_bayes_weights(rows, "comment_id", "label_id", "kfold", "terms", 0, CLASSES, 2)
    return weights.withColumn("weight", F.round("weight", 6))


@query("word_and_char_test_predictions", "M6 M7 T17 T19")
def word_and_char_test_predictions(spark, sf):
    flags, products = tx.domain_flags("text", DEMO_PATTERNS), tx.flag_interactions()
    flagged = folded_features(spark, sf, "text").withColumns(flags).withColumns(products)
    _, predicted = models.fit_union_test(flagged, "comment_id", "feature", "label_id", [*flags, *products], max_iter=STEPS)
    return test_table(predicted)


@query("out_of_fold_predictions", "M14 G7")
def out_of_fold_predictions(spark, sf):
    predicted = models.out_of_fold_words(
        folded_features(spark, sf).drop("fold"), "comment_id", "feature", "label_id", max_iter=STEPS)
    return predicted.select("comment_id", "label_id", "kfold", F.col("prediction").cast("int").alias("predicted"))


@query("top_model_features", "M25 G1")
def top_model_features(spark, sf):
    train, _ = train_test(folded_features(spark, sf))
    terms = models.word_terms(train, "feature", ["comment_id", "label_id", "fold"])
    fitted = models.fit_words(terms, "comment_id", "label_id", "fold", ["test"], 0, [0.1], 2, STEPS)
    first = materialize(fitted.top_terms(15), "top-terms")
    fitted.close(whole=True)
    return first


@query("version_sweep", "M31 M30")
def version_sweep(spark, sf):
    """The SVM's test scores for each subset of the data, at the subset's own best setting."""
    base = labelled(spark, sf).select(
        "comment_id", "label_id", "lang", "n_chars", tx.feature_text("text", DEMO_SLANG, DEMO_STOPWORDS).alias("feature"))
    base = materialize(base.hint("rebalance"), "cleaned")  # texts are cleaned once for all subsets
    subsets = {"all": base, "english": base.filter("lang = 'en'"), "long": base.filter("n_chars >= 1000")}
    parts = []
    for name, df in subsets.items():
        folded = materialize(stratified_split(df, "comment_id", "label_id").hint("rebalance"), "folds", "fold")
        grid = models.grid_search(folded, "comment_id", "feature", "label_id", max_iter=STEPS)
        _, predicted = models.refit_best(folded, "comment_id", "feature", "label_id", grid, max_iter=STEPS)
        parts.append(evaluate(predicted, "label_id", "prediction").withColumn("subset", F.lit(name)))
    return union_all(parts)


@query("out_of_fold_rows", "M14 M11 G7", held_out_sql(KFOLD_SQL, "(0), (1), (2), (3), (4)",
    "SELECT comment_id, label_id, kfold, CAST(coalesce(c, 0) AS INTEGER) AS predicted FROM rows LEFT JOIN best USING (comment_id)"))
def out_of_fold_rows(spark, sf):
    """Each row predicted once, by the naive Bayes of the other folds; all five from one reading."""
    df = models.nonempty(folded_features(spark, sf).drop("fold"), "feature")
    folded = stratified_kfold(df, "comment_id", "label_id", 5).withColumn("words", tx.tokens("feature"))
    folded = materialize(folded.select("comment_id", "label_id", "kfold", "words"), "words")
    rows = folded.select("comment_id", "label_id", "kfold", tx.word_ngrams(F.col("words"), 2).alias("terms"))
    return bayes.held_out_predictions(rows, "comment_id", "label_id", "kfold", "terms", range(5), CLASSES, 2)


@query("embedding_classifier", "M32 M8")
def embedding_classifier(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("comment_id"), F.col("label").alias("label_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    folded = materialize(stratified_split(vectors, "comment_id", "label_id"), "folds", "fold")
    train, test = folded.filter("fold <> 'test'"), folded.filter("fold = 'test'")
    return test_table(models.fit_and_predict(train, test, [], models.logistic("label_id"), "label_id")[1])
