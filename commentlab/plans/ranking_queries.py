"""Top-n, dedup, samples, folds and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curation, ranking
from ..operators.keyed import first_per_key, top_per_key
from ..session import materialize
from . import sqltext as st
from .registry import query
from .tables import LABELLED_SQL, PREDICTIONS_SQL, labelled, predictions, table, texts

RANK = "CAST(row_number() OVER (PARTITION BY {p} ORDER BY {o}) AS INTEGER)"


@query("balanced_subset", "G1 U1", f"""WITH {LABELLED_SQL}
SELECT comment_id, label_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY confidence DESC, comment_id) AS r FROM labelled)
WHERE r <= 40""")
def balanced_subset(spark, sf):
    df = labelled(spark, sf).select("comment_id", "label_id", "confidence")
    return curation.balanced_subset(df, "label_id", "comment_id", "confidence", 40)


@query("balanced_subset_large", "G1", """SELECT l_returnflag, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r
  FROM lineitem) WHERE r <= 3000""")
def balanced_subset_large(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return top_per_key(df, ["l_returnflag"], order, 3000).drop("l_extendedprice")


@query("balanced_subset_verified_first", "G2", f"""WITH {LABELLED_SQL}
SELECT comment_id, label_id, confidence, verified FROM (
  SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY verified DESC, confidence DESC, comment_id) AS r
  FROM (SELECT *, lang = 'de' AS verified FROM labelled)) WHERE r <= 40""")
def balanced_subset_verified_first(spark, sf):
    df = labelled(spark, sf).select("comment_id", "label_id", "confidence", (F.col("lang") == "de").alias("verified"))
    return curation.balanced_subset(df, "label_id", "comment_id", "confidence", 40, "verified")


@query("dedup_by_text", "G3", f"""SELECT comment_id, verified, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY lower({st.squeeze('text')})
                               ORDER BY verified DESC, confidence DESC, comment_id) AS r
  FROM (SELECT doc_id AS comment_id, text, lang = 'en' AS verified, (doc_id * 7919 % 1000) / 1000e0 AS confidence
        FROM documents)) WHERE r = 1""")
def dedup_by_text(spark, sf):
    df = texts(spark, sf).select("comment_id", "text", (F.col("lang") == "en").alias("verified"), "confidence")
    best = [F.desc("verified"), F.desc("confidence")]
    return curation.dedup_by_text(df, "text", "comment_id", best).drop("text")


@query("dedup_by_id", "G4", """SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def dedup_by_id(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return first_per_key(turns, ["conv_id"], [F.asc("turn")])


def quota_sql(totals: str, size: str, amount: str, out: str) -> str:
    """Largest remainder over one row per class."""
    return f"""(SELECT *, CAST(({amount} * {size}) // _all + CASE WHEN row_number() OVER (
        ORDER BY ({amount} * {size}) % _all DESC, label_id) <= {amount} - sum(({amount} * {size}) // _all) OVER ()
      THEN 1 ELSE 0 END AS BIGINT) AS {out}
    FROM (SELECT *, CAST(sum({size}) OVER () AS BIGINT) AS _all FROM {totals}))"""


SPLIT_SQL = f"""q0 AS (SELECT label_id, count(*) AS n_all FROM members GROUP BY 1),
q1 AS (SELECT label_id, n_all, n_test, n_all - n_test AS n_left
       FROM {quota_sql('q0', 'n_all', '((_all + 9) // 10)', 'n_test')}),
q2 AS (SELECT label_id, n_all, n_test, n_val, n_left - n_val AS n_train
       FROM {quota_sql('q1', 'n_left', '((_all * 2 + 8) // 9)', 'n_val')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS r
           FROM members),
folded AS (SELECT ranked.*, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS fold
           FROM ranked JOIN q2 ON ranked.label_id = q2.label_id)"""


@query("split_quotas", "G5", f"""WITH {LABELLED_SQL}, members AS (SELECT comment_id, label_id FROM labelled), {SPLIT_SQL}
SELECT label_id, n_all, n_test, n_val, n_train FROM q2""")
def split_quotas(spark, sf):
    return ranking.split_quotas(labelled(spark, sf).select("label_id"), "label_id")


@query("stratified_split", "G5 G6 J4", f"""WITH {LABELLED_SQL}, members AS (SELECT comment_id, label_id FROM labelled),
{SPLIT_SQL} SELECT comment_id, label_id, fold FROM folded""")
def stratified_split(spark, sf):
    members = labelled(spark, sf).select("comment_id", "label_id")
    return ranking.stratified_split(members, "comment_id", "label_id")


@query("stratified_split_orders", "G5", f"""WITH members AS (SELECT o_orderkey AS comment_id,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label_id FROM orders), {SPLIT_SQL}
SELECT label_id, fold, count(*) AS n, CAST(sum(comment_id) AS BIGINT) AS id_sum FROM folded GROUP BY 1, 2""")
def stratified_split_orders(spark, sf):
    status = F.col("o_orderstatus")
    members = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("comment_id"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label_id"))
    folded = ranking.stratified_split(members, "comment_id", "label_id")
    return folded.groupBy("label_id", "fold").agg(F.count("*").alias("n"), F.sum("comment_id").alias("id_sum"))


@query("stratified_folds", "G7", f"""WITH {LABELLED_SQL},
r AS (SELECT comment_id, label_id, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS r,
      count(*) OVER (PARTITION BY label_id) AS n FROM labelled)
SELECT comment_id, label_id, CASE WHEN r <= n // 5 THEN 0 WHEN r <= n * 2 // 5 THEN 1 WHEN r <= n * 3 // 5 THEN 2
  WHEN r <= n * 4 // 5 THEN 3 ELSE 4 END AS kfold FROM r""")
def stratified_folds(spark, sf):
    members = labelled(spark, sf).select("comment_id", "label_id")
    return ranking.stratified_kfold(members, "comment_id", "label_id", 5)


@query("sample_exact", "G8", "SELECT doc_id AS comment_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_exact(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"), "lang")
    return ranking.sample_exact(docs, "comment_id", 100, require=True)


@query("sample_per_class_random", "G9 P4 J6", f"""WITH {LABELLED_SQL},
pool AS (SELECT * FROM labelled WHERE label_id IN (0, 2) AND lang <> 'es' AND n_chars >= 200)
SELECT comment_id, label_id FROM (SELECT *, row_number() OVER (
  PARTITION BY label_id ORDER BY md5('7:' || comment_id), comment_id) AS r FROM pool) WHERE r <= 30""")
def sample_per_class_random(spark, sf):
    df = labelled(spark, sf)
    used = df.filter(F.col("lang") == "es").select("comment_id").union(
        df.filter(F.col("n_chars") < 200).select("comment_id")).distinct()
    pool = df.filter(F.col("label_id").isin(0, 2)).select("comment_id", "label_id").join(used, "comment_id", "left_anti")
    return ranking.sample_exact(pool, "comment_id", 30, "label_id", seed=7)


@query("sample_per_class_confident", "G9 P4", f"""WITH {LABELLED_SQL}
SELECT comment_id, label_id FROM (SELECT *, row_number() OVER (
  PARTITION BY label_id ORDER BY confidence DESC, comment_id) AS r FROM labelled WHERE label_id IN (0, 2)) WHERE r <= 30""")
def sample_per_class_confident(spark, sf):
    pool = labelled(spark, sf).filter(F.col("label_id").isin(0, 2)).select("comment_id", "label_id", "confidence")
    return ranking.top_by_score(pool, "label_id", 30, "comment_id", "confidence").drop("confidence")


@query("shuffled_order", "G10", """SELECT doc_id AS comment_id,
  row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position FROM documents""")
def shuffled_order(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"))
    return ranking.shuffled_rank(docs, "comment_id", out="position")


@query("round_robin_order", "G11", f"""WITH {LABELLED_SQL}
SELECT comment_id, label_id, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS turn
FROM labelled ORDER BY turn, label_id""")
def round_robin_order(spark, sf):
    members = labelled(spark, sf).select("comment_id", "label_id")
    return ranking.round_robin(members, "comment_id", "label_id").orderBy("turn", "label_id")


@query("resize_review_set", "G12", f"""WITH {LABELLED_SQL},
o AS (SELECT comment_id, label_id, human_id <> label_id AS annotated, row_number() OVER (
      PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS turn FROM labelled),
k AS (SELECT *, row_number() OVER (ORDER BY turn, label_id) AS p FROM o)
SELECT count(*) FILTER (p <= 100) AS n_kept, count(*) FILTER (p > 100) AS n_dropped,
  count(*) FILTER (p > 100 AND annotated) AS n_blocked FROM k""")
def resize_review_set(spark, sf):
    members = labelled(spark, sf).select(
        "comment_id", "label_id", (F.col("human_id") != F.col("label_id")).alias("annotated"))
    keep = ranking.round_robin(members, "comment_id", "label_id").orderBy("turn", "label_id").limit(100)
    marked = members.join(F.broadcast(keep.select("comment_id", F.lit(True).alias("kept"))), "comment_id", "left")
    dropped = F.col("kept").isNull()
    return marked.agg(
        F.count_if(~dropped).alias("n_kept"), F.count_if(dropped).alias("n_dropped"),
        F.count_if(dropped & F.col("annotated")).alias("n_blocked"))


@query("rank_within_group", "G13", """SELECT l_orderkey, l_linenumber, l_returnflag,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem""")
def rank_within_group(spark, sf):
    # One number for the place of a line, since an order has fewer than ten thousand of them.
    position = F.col("l_orderkey") * 10_000 + F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", position.alias("position"))
    df = ranking.with_quantile_bucket(df, "position")
    return ranking.exact_rank(df, ["l_returnflag"], F.col("_quantile"), [F.asc("position")]).drop("position", "_quantile")


RUNS_SQL = PREDICTIONS_SQL + """, runs AS (SELECT lang AS dataset, video_id AS model,
  round(count(*) FILTER (actual = predicted) / count(*), 6) AS accuracy, count(*) AS n_test FROM predictions GROUP BY 1, 2)"""


def runs(spark, sf):
    right = F.count_if(F.col("actual") == F.col("predicted"))
    return predictions(spark, sf).groupBy(F.col("lang").alias("dataset"), F.col("video_id").alias("model")).agg(
        F.round(right / F.count("*"), 6).alias("accuracy"), F.count("*").alias("n_test"))


@query("best_model_per_dataset", "G15", f"""WITH {RUNS_SQL}
SELECT dataset, model, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, model) AS r
FROM runs) WHERE r = 1""")
def best_model_per_dataset(spark, sf):
    best = first_per_key(runs(spark, sf), ["dataset"], [F.desc("accuracy"), F.asc("model")])
    return best.select("dataset", "model", "accuracy")


@query("models_by_metric", "G16", f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY accuracy, dataset, model")
def models_by_metric(spark, sf):
    return runs(spark, sf).orderBy("accuracy", "dataset", "model")


@query("most_confident_errors", "G19", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, actual, predicted, confidence FROM predictions WHERE actual <> predicted
ORDER BY confidence DESC, comment_id LIMIT 20""")
def most_confident_errors(spark, sf):
    wrong = predictions(spark, sf).filter(F.col("actual") != F.col("predicted"))
    return wrong.select("comment_id", "actual", "predicted", "confidence").orderBy(
        F.desc("confidence"), "comment_id").limit(20)


@query("class_samples_of_middle_length", "G20 P11", f"""WITH {LABELLED_SQL},
t AS (SELECT comment_id, label_id, {st.squeeze('text')} AS sq FROM labelled),
p AS (SELECT * FROM t WHERE len(string_split(sq, ' ')) BETWEEN 50 AND 200)
SELECT comment_id, label_id FROM (SELECT *, row_number() OVER (
  PARTITION BY label_id ORDER BY md5('42:' || comment_id), comment_id) AS r FROM p) WHERE r <= 3""")
def class_samples_of_middle_length(spark, sf):
    pool = labelled(spark, sf).filter(tx.word_count("text").between(50, 200)).select("comment_id", "label_id")
    # Sampling reads its pool a few times, so texts are counted once and the ids kept.
    return ranking.sample_exact(materialize(pool, "pool"), "comment_id", 3, "label_id")
