"""Features as relations, decisions, metrics and run tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import features, metrics
from ..operators.ranking import stratified_kfold
from . import sqltext as st
from .registry import query
from .tables import LABELLED_SQL, NAME_SQL, PREDICTIONS_SQL, SCORES_SQL, labelled, predictions, scores, table

DOCS_SQL = LABELLED_SQL + f", docs AS (SELECT comment_id, label_id, {st.words(st.clean_aggressive('text'))} AS ws FROM labelled)"
TF_SQL = DOCS_SQL + """, toks AS (SELECT comment_id, unnest(ws) AS term FROM docs),
tf AS (SELECT comment_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM tf GROUP BY 1 HAVING count(*) >= 2)"""


def docs(spark, sf):
    return labelled(spark, sf).select(
        "comment_id", "label_id", tx.tokens(tx.clean_aggressive("text")).alias("words"))


@query("term_vocabulary", "M1", f"WITH {TF_SQL} SELECT term, df, uses FROM vocab")
def term_vocabulary(spark, sf):
    return features.vocabulary(features.term_counts(docs(spark, sf), "comment_id", "words"), 2)


@query("sublinear_term_frequency", "M2", f"""WITH {TF_SQL}
SELECT comment_id, term, tf, round(1 + ln(tf), 6) AS sublinear FROM tf""")
def sublinear_term_frequency(spark, sf):
    tf = features.term_counts(docs(spark, sf), "comment_id", "words")
    return tf.withColumn("sublinear", F.round(1 + F.log("tf"), 6))


@query("inverse_document_frequency", "M3", f"""WITH {TF_SQL}
SELECT term, round(ln(((SELECT count(*) FROM docs) + 1) / (df + 1)), 6) AS idf FROM vocab""")
def inverse_document_frequency(spark, sf):
    d = docs(spark, sf)
    n = features.scalar_of(d, F.count("*"))
    counts = features.term_counts(d, "comment_id", "words")
    return features.vocabulary(counts, 2).select("term", F.round(F.log((n + 1) / (F.col("df") + 1)), 6).alias("idf"))


def tfidf_sql(plus: str) -> str:
    return f"""WITH {TF_SQL},
w AS (SELECT tf.comment_id, tf.term, tf.tf,
      (1 + ln(tf.tf)) * (ln(((SELECT count(*) FROM docs) + 1) / (v.df + 1)) {plus}) AS raw FROM tf JOIN vocab v ON tf.term = v.term),
s AS (SELECT comment_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1)
SELECT w.comment_id, term, tf, round(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END, 6) AS weight
FROM w JOIN s ON w.comment_id = s.comment_id"""


@query("tfidf_weights", "M4 M5", tfidf_sql(""))
def tfidf_weights(spark, sf):
    return features.tfidf(docs(spark, sf), "comment_id", "words", 2)


@query("tfidf_weights_idf_plus_one", "M3 M5", tfidf_sql("+ 1"))
def tfidf_weights_idf_plus_one(spark, sf):
    return features.tfidf(docs(spark, sf), "comment_id", "words", 2, idf_plus_one=True)


@query("class_weights", "M8", f"""WITH {LABELLED_SQL}
SELECT label_id, count(*) AS n, (SELECT count(*) FROM labelled)
  / ((SELECT count(DISTINCT label_id) FROM labelled) * count(*)) AS weight FROM labelled GROUP BY 1""")
def class_weights(spark, sf):
    return features.class_weights(labelled(spark, sf), "label_id")


def score_array(spark, sf):
    return scores(spark, sf).withColumn("scores", F.array("s0", "s1", "s2"))


@query("decision_margin", "M16", f"""WITH {SCORES_SQL}
SELECT comment_id, round(list_sort([s0, s1, s2], 'DESC')[1] - list_sort([s0, s1, s2], 'DESC')[2], 6) AS margin FROM scores""")
def decision_margin(spark, sf):
    return score_array(spark, sf).select("comment_id", F.round(vec.margin(F.col("scores")), 6).alias("margin"))


@query("softmax_confidence", "M17", f"""WITH {SCORES_SQL}, m AS (SELECT *, greatest(s0, s1, s2) AS t FROM scores)
SELECT comment_id, round(1 / (exp(s0 - t) + exp(s1 - t) + exp(s2 - t)), 4) AS confidence FROM m""")
def softmax_confidence(spark, sf):
    return score_array(spark, sf).select("comment_id", vec.softmax_confidence(F.col("scores")).alias("confidence"))


ARGMAX = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END"


@query("biased_decision", "M18", f"""WITH {SCORES_SQL}
SELECT comment_id, {ARGMAX.format('s0', 's1', 's2')} AS plain,
  {ARGMAX.format('(s0 + 0.3e0)', 's1', '(s2 - 0.2e0)')} AS biased FROM scores""")
def biased_decision(spark, sf):
    s = F.col("scores")
    return score_array(spark, sf).select(
        "comment_id", vec.argmax(s).alias("plain"), vec.argmax(vec.add_bias(s, [0.3, 0.0, -0.2])).alias("biased"))


GRID = [(i - 6) / 10.0 for i in range(13)]

CELLS = ", ".join(
    f"count(*) FILTER (actual = {i} AND predicted = {j}) AS c{i}{j}" for i in range(3) for j in range(3))


def f1_sql(i: int) -> str:
    support = " + ".join(f"c{i}{j}" for j in range(3))
    guessed = " + ".join(f"c{j}{i}" for j in range(3))
    both = f"({support} + {guessed})"
    return f"(CASE WHEN {both} <> 0 THEN 2 * c{i}{i} / {both} ELSE 0e0 END)"


N_CELLS = "(" + " + ".join(f"c{i}{j}" for i in range(3) for j in range(3)) + ")"
SCORE_COLS = f"""round(CASE WHEN {N_CELLS} <> 0 THEN (c00 + c11 + c22) / {N_CELLS} ELSE 0e0 END, 6) AS accuracy,
  round(({f1_sql(0)} + {f1_sql(1)} + {f1_sql(2)}) / 3, 6) AS macro_f1,
  round(CASE WHEN {N_CELLS} <> 0 THEN ({" + ".join(f"{f1_sql(i)} * (c{i}0 + c{i}1 + c{i}2)" for i in range(3))}) / {N_CELLS} ELSE 0e0 END, 6) AS weighted_f1,
  {N_CELLS} AS n_test"""

BIAS_CELLS = f"""WITH {SCORES_SQL}, g AS (SELECT (range - 6) / 10e0 AS b FROM range(13)),
p AS (SELECT a.b AS bias_0, c.b AS bias_2, label_id AS actual, {ARGMAX.format('(s0 + a.b)', 's1', '(s2 + c.b)')} AS predicted
      FROM scores, g a, g c),
cells AS (SELECT bias_0, bias_2, {CELLS} FROM p GROUP BY 1, 2)"""
BIAS_SQL = f"{BIAS_CELLS} SELECT bias_0, bias_2, {SCORE_COLS} FROM cells"


@query("bias_grid", "M19 J11", BIAS_SQL)
def bias_grid(spark, sf):
    return metrics.bias_grid(scores(spark, sf), "label_id", "s0", "s1", "s2", GRID)


@query("best_bias", "M19", BIAS_SQL + " ORDER BY macro_f1 DESC, bias_0, bias_2 LIMIT 1")
def best_bias(spark, sf):
    return metrics.best_bias(bias_grid(spark, sf))


RUN_CELLS = f"{PREDICTIONS_SQL}, cells AS (SELECT lang AS dataset, video_id AS model, {CELLS} FROM predictions GROUP BY 1, 2)"
RUN = ["dataset", "model"]


def run_cells(spark, sf):
    p = predictions(spark, sf).select(
        F.col("lang").alias("dataset"), F.col("video_id").alias("model"), "actual", "predicted")
    return metrics.confusion_cells(p, "actual", "predicted", RUN)


def long_sql(value) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, model, {i} AS actual, {j} AS predicted, {value(i, j)} FROM cells" for i in range(3) for j in range(3))


@query("confusion_matrix", "M20", f"""WITH {PREDICTIONS_SQL}, cells AS (SELECT {CELLS} FROM predictions)
{" UNION ALL ".join(f"SELECT {i} AS actual, {j} AS predicted, c{i}{j} AS n FROM cells" for i in range(3) for j in range(3))}""")
def confusion_matrix(spark, sf):
    return metrics.confusion_long(metrics.confusion_cells(predictions(spark, sf), "actual", "predicted"))


@query("confusion_matrix_per_run", "M20", f"WITH {RUN_CELLS} {long_sql(lambda i, j: f'c{i}{j} AS n')}")
def confusion_matrix_per_run(spark, sf):
    return metrics.confusion_long(run_cells(spark, sf), RUN)


@query("model_scores", "M21", f"WITH {PREDICTIONS_SQL}, cells AS (SELECT {CELLS} FROM predictions) SELECT {SCORE_COLS} FROM cells")
def model_scores(spark, sf):
    return metrics.evaluate(predictions(spark, sf), "actual", "predicted")


@query("model_scores_per_run", "M21", f"WITH {RUN_CELLS} SELECT dataset, model, {SCORE_COLS} FROM cells")
def model_scores_per_run(spark, sf):
    return metrics.scores_from_cells(run_cells(spark, sf), RUN)


def class_sql(i: int) -> str:
    support, guessed = f"(c{i}0 + c{i}1 + c{i}2)", f"(c0{i} + c1{i} + c2{i})"
    return f"""SELECT dataset, model, {i} AS label_id,
  round(CASE WHEN {guessed} <> 0 THEN c{i}{i} / {guessed} ELSE 0e0 END, 6) AS precision,
  round(CASE WHEN {support} <> 0 THEN c{i}{i} / {support} ELSE 0e0 END, 6) AS recall,
  round({f1_sql(i)}, 6) AS f1, {support} AS support FROM cells"""


@query("class_scores_per_run", "M21", f"WITH {RUN_CELLS} " + " UNION ALL ".join(map(class_sql, range(3))))
def class_scores_per_run(spark, sf):
    return metrics.per_class_from_cells(run_cells(spark, sf), RUN)


@query("precision_recall_from_matrix", "M22", f"WITH {RUN_CELLS} " + " UNION ALL ".join(
    f"""SELECT dataset, model, {i} AS label_id, round(c{i}{i} / nullif(c0{i} + c1{i} + c2{i}, 0), 4) AS precision,
  round(c{i}{i} / nullif(c{i}0 + c{i}1 + c{i}2, 0), 4) AS recall FROM cells""" for i in range(3)))
def precision_recall_from_matrix(spark, sf):
    matrix = F.array(*[F.array(*[F.col(f"c{i}{j}") for j in range(3)]) for i in range(3)])
    stored = run_cells(spark, sf).select(*RUN, matrix.alias("matrix"))
    return metrics.matrix_precision_recall(stored, "matrix", RUN)


@query("normalized_matrix", "M23", f"""WITH {RUN_CELLS}
{long_sql(lambda i, j: f'round(c{i}{j} / nullif(c{i}0 + c{i}1 + c{i}2, 0), 6) AS share')}""")
def normalized_matrix(spark, sf):
    return metrics.row_shares(run_cells(spark, sf), RUN)


@query("prediction_table", "M24 G19", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, {NAME_SQL.format('actual')} AS label_asli, {NAME_SQL.format('predicted')} AS prediksi,
  actual = predicted AS benar, confidence AS keyakinan FROM predictions""")
def prediction_table(spark, sf):
    return predictions(spark, sf).select(
        "comment_id", lb.label_name("actual").alias("label_asli"), lb.label_name("predicted").alias("prediksi"),
        (F.col("actual") == F.col("predicted")).alias("benar"), F.col("confidence").alias("keyakinan"))


@query("hard_vote", "M12", f"""WITH {SCORES_SQL}, v AS (
  SELECT comment_id, {ARGMAX.format('s0', 's1', 's2')} AS p FROM scores
  UNION ALL SELECT comment_id, {ARGMAX.format('s1', 's2', 's0')} FROM scores
  UNION ALL SELECT comment_id, label_id FROM scores),
c AS (SELECT comment_id, p, count(*) AS n FROM v GROUP BY 1, 2)
SELECT comment_id, p AS predicted, n AS n_votes FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY n DESC, p) AS r FROM c) WHERE r = 1""")
def hard_vote(spark, sf):
    models = F.array(vec.argmax(F.array("s0", "s1", "s2")), vec.argmax(F.array("s1", "s2", "s0")), F.col("label_id"))
    votes = scores(spark, sf).select("comment_id", F.explode(models).alias("p"))
    return metrics.hard_vote(votes, "comment_id", "p")


@query("fold_mean_and_spread", "M15 G7", f"""WITH {PREDICTIONS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY actual ORDER BY md5('42:' || comment_id), comment_id) AS r,
      count(*) OVER (PARTITION BY actual) AS n FROM predictions),
k AS (SELECT actual, predicted, CASE WHEN r <= n // 5 THEN 0 WHEN r <= n * 2 // 5 THEN 1 WHEN r <= n * 3 // 5 THEN 2
      WHEN r <= n * 4 // 5 THEN 3 ELSE 4 END AS kfold FROM r),
cells AS (SELECT kfold, {CELLS} FROM k GROUP BY 1), s AS (SELECT {SCORE_COLS} FROM cells)
SELECT round(avg(macro_f1), 6) AS mean_score, round(stddev_pop(macro_f1), 6) AS std_score FROM s""")
def fold_mean_and_spread(spark, sf):
    folded = stratified_kfold(predictions(spark, sf).select("comment_id", "actual", "predicted"), "comment_id", "actual")
    per_fold = metrics.evaluate(folded, "actual", "predicted", ["kfold"])
    return metrics.mean_and_spread(per_fold, "macro_f1")


@query("grid_ranking", "M26", f"""{BIAS_CELLS}, s AS (SELECT bias_0, bias_2, {SCORE_COLS} FROM cells)
SELECT bias_0, bias_2, macro_f1, CAST(rank() OVER (ORDER BY macro_f1 DESC) AS INTEGER) AS rank FROM s""")
def grid_ranking(spark, sf):
    grid = bias_grid(spark, sf).select("bias_0", "bias_2", "macro_f1")  # one row per pair of biases
    return grid.withColumn("rank", F.rank().over(W.orderBy(F.desc("macro_f1"))))


RUN_SCORES = f"{RUN_CELLS}, runs AS (SELECT dataset, model, {SCORE_COLS} FROM cells)"


# Sources two by two: an even one is the first engine of its version, the odd one after it the second.
ENGINES_SQL = f"""WITH {RUN_SCORES}, numbered AS (SELECT *, CAST(substr(model, 4) AS INTEGER) AS i FROM runs),
pairs AS (SELECT a.dataset, a.i // 2 AS version, a.macro_f1 AS "first", b.macro_f1 AS "second" FROM numbered a
          JOIN numbered b ON a.dataset = b.dataset AND a.i % 2 = 0 AND b.i = a.i + 1)"""


@query("engine_comparison", "M28", f"""{ENGINES_SQL}
SELECT dataset, version, "first", "second", round("second" - "first", 4) AS difference FROM pairs""")
def engine_comparison(spark, sf):
    number = F.substring("model", 4, 10).cast("int")
    runs = metrics.scores_from_cells(run_cells(spark, sf), RUN).withColumns({"i": number, "version": F.expr("CAST(substring(model, 4) AS INT) DIV 2").cast("int")})
    return metrics.compare_engines(runs.filter("i % 2 = 0"), runs.filter("i % 2 = 1"), ["dataset", "version"], "macro_f1")


@query("version_winner", "M29", f"""{ENGINES_SQL}
SELECT dataset, version, CASE WHEN "first" > "second" THEN 'even' ELSE 'odd' END AS winner FROM pairs""")
def version_winner(spark, sf):
    pairs = engine_comparison(spark, sf)
    return pairs.select("dataset", "version", metrics.winner(pairs, "first", "second", ("even", "odd")).alias("winner"))


@query("history_reshape", "M33", """SELECT user_id AS epoch, value AS eval_loss, event_id AS step FROM events
WHERE event_type = 'view' AND value IS NOT NULL""")
def history_reshape(spark, sf):
    loss = F.when(F.col("event_type") == "view", F.col("value"))
    history = table(spark, sf, "events").select(F.col("user_id").alias("epoch"), loss.alias("eval_loss"), F.col("event_id").alias("step"))
    return history.filter("eval_loss IS NOT NULL")


@query("variant_table", "M30", f"""WITH {SCORES_SQL}, p AS (
  SELECT 'base' AS variant, label_id AS actual, {ARGMAX.format('s0', 's1', 's2')} AS predicted FROM scores
  UNION ALL SELECT 'biased', label_id, {ARGMAX.format('(s0 + 0.3e0)', 's1', '(s2 - 0.2e0)')} FROM scores
  UNION ALL SELECT 'negative', label_id, {ARGMAX.format('(-s0)', '(-s1)', '(-s2)')} FROM scores),
cells AS (SELECT variant, {CELLS} FROM p GROUP BY 1)
SELECT variant, {SCORE_COLS}, round({f1_sql(0)}, 6) AS f1_negatif, round({f1_sql(1)}, 6) AS f1_netral,
  round({f1_sql(2)}, 6) AS f1_positif FROM cells""")
def variant_table(spark, sf):
    s = F.col("scores")
    variants = {
        "base": vec.argmax(s),
        "biased": vec.argmax(vec.add_bias(s, [0.3, 0.0, -0.2])),
        "negative": vec.argmax(F.transform(s, lambda x: -x)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), p.alias("predicted")) for n, p in variants.items()])
    long = score_array(spark, sf).select(F.col("label_id").alias("actual"), F.inline(rows))
    cells = metrics.confusion_cells(long, "actual", "predicted", ["variant"])
    per_class = metrics.per_class_from_cells(cells, ["variant"]).groupBy("variant").agg(
        *[F.max(F.when(F.col("label_id") == i, F.col("f1"))).alias(n)
          for i, n in enumerate(["f1_negatif", "f1_netral", "f1_positif"])])
    return metrics.scores_from_cells(cells, ["variant"]).join(per_class, "variant")
