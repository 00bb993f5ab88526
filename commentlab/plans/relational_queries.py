"""Scans, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import upsert
from ..operators.curation import apply_updates
from ..operators.keyed import union_all
from ..operators.ranking import exact_rank, with_quantile_bucket
from . import sqltext as st
from .registry import query
from .tables import COMMENTS_SQL, LABELLED_SQL, NAME_SQL, PREDICTIONS_SQL, comments, labelled, predictions, table, text_table, texts

# A second reading of the German comments: labels moved on by one, sure of itself.
CORRECTIONS_SQL = LABELLED_SQL + """, corrections AS (
  SELECT comment_id, (label_id + 1) % 3 AS label_id, 0.95e0 AS confidence FROM labelled WHERE lang = 'de')"""


def corrections(spark, sf):
    return labelled(spark, sf).filter(F.col("lang") == "de").select(
        "comment_id", ((F.col("label_id") + 1) % 3).alias("label_id"), F.lit(0.95).alias("confidence"))


def path_a(spark, sf):
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").alias("comment_id"), F.md5(tx.clean_aggressive("text")).alias("aggressive"))


def path_b(spark, sf):
    """Of the documents that have labels; the others have no second path."""
    docs = text_table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("comment_id"), F.md5(tx.clean_minimal("text")).alias("minimal"))


A_SQL = f"a AS (SELECT doc_id AS comment_id, md5({st.clean_aggressive('text')}) AS aggressive FROM documents)"
B_SQL = f"b AS (SELECT doc_id AS comment_id, md5({st.clean_minimal('text')}) AS minimal FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query("pruned_scan", "S1", "SELECT l_orderkey, l_quantity FROM lineitem")
def pruned_scan(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query("filtered_scan", "S7", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def filtered_scan(spark, sf):
    hit = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull()
    return table(spark, sf, "orders").filter(hit).select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("labelled_rows", "P1", f"WITH {COMMENTS_SQL} SELECT comment_id, label_id FROM comments WHERE label_id IS NOT NULL")
def labelled_rows(spark, sf):
    return comments(spark, sf).filter(F.col("label_id").isNotNull()).select("comment_id", "label_id")


@query("nonempty_features", "P2", f"""SELECT conv_id, turn FROM conversations
WHERE length({st.clean_aggressive('text')}) > 0""")
def nonempty_features(spark, sf):
    return table(spark, sf, "conversations").filter(F.length(tx.clean_aggressive("text")) > 0).select("conv_id", "turn")




@query("rows_filled_on_both_paths", "P3", f"""SELECT page_id,
  {st.no_url('url')} <> ' ' AS keep_any FROM pages
WHERE length({st.clean_aggressive('html')}) > 0 AND length({st.clean_minimal('html')}) > 0""")
def rows_filled_on_both_paths(spark, sf):
    both = (F.length(tx.clean_aggressive("html")) > 0) & (F.length(tx.clean_minimal("html")) > 0)
    either = (F.length(tx.clean_aggressive("url")) > 0) | (F.length(tx.clean_minimal("url")) > 0)
    return text_table(spark, sf, "pages").filter(both).select("page_id", either.alias("keep_any"))


@query("class_membership", "P4", f"""WITH {LABELLED_SQL}
SELECT comment_id, {NAME_SQL.format('label_id')} AS label FROM labelled WHERE label_id IN (0, 2)""")
def class_membership(spark, sf):
    return labelled(spark, sf).filter(F.col("label_id").isin(0, 2)).select(
        "comment_id", lb.label_name("label_id").alias("label"))


MARGIN = "round(abs((comment_id * 6101 % 991) / 991e0 - (comment_id * 4733 % 983) / 983e0), 6)"


def margin():
    i = F.col("comment_id")
    return F.round(F.abs(i * 6101 % 991 / F.lit(991.0) - i * 4733 % 983 / F.lit(983.0)), 6)


@query("low_confidence_queue", "P5", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, confidence, {MARGIN} AS margin FROM predictions WHERE confidence <= 0.6
ORDER BY confidence, margin DESC, comment_id""")
def low_confidence_queue(spark, sf):
    return predictions(spark, sf).filter(F.col("confidence") <= 0.6).select(
        "comment_id", "confidence", margin().alias("margin")).orderBy("confidence", F.desc("margin"), "comment_id")


@query("disagreement_queue", "P6", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, actual, predicted, {MARGIN} AS margin FROM predictions WHERE actual <> predicted
ORDER BY margin DESC, comment_id""")
def disagreement_queue(spark, sf):
    return predictions(spark, sf).filter(F.col("actual") != F.col("predicted")).select(
        "comment_id", "actual", "predicted", margin().alias("margin")).orderBy(F.desc("margin"), "comment_id")


def filter_predictions(df, models=None, actual=None, predicted=None, status=None, keyword=None):
    """Every facet is optional; those given must all hold."""
    if models:
        df = df.filter(F.col("video_id").isin(models))
    if actual:
        df = df.filter(lb.label_name("actual").isin(actual))
    if predicted:
        df = df.filter(lb.label_name("predicted").isin(predicted))
    if status:
        df = df.filter(lb.error_status(F.col("actual") == F.col("predicted")) == status)
    if keyword:
        df = df.filter(tx.matches_keyword("text", keyword))
    return df


@query("facet_filter", "P7 T22", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, video_id FROM predictions WHERE lang IN ('en', 'fr', 'de', 'es')
  AND video_id IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')
  AND actual IN (0, 2) AND predicted <> 0 AND regexp_matches(text, '(?i)th|ou')""")
def facet_filter(spark, sf):
    return filter_predictions(
        predictions(spark, sf), [f"src{i}" for i in range(8)], ["Negatif", "Positif"], ["Netral", "Positif"],
        keyword="th|ou").select("comment_id", "video_id")


@query("join_feature_paths", "J1", f"""WITH {A_SQL}, {B_SQL}
SELECT a.comment_id, aggressive, minimal FROM a LEFT JOIN b ON a.comment_id = b.comment_id""")
def join_feature_paths(spark, sf):
    return path_a(spark, sf).join(path_b(spark, sf), "comment_id", "left")


@query("join_originals_and_paths", "J2", f"""WITH {A_SQL}, {B_SQL}
SELECT d.doc_id AS comment_id, d.lang, aggressive, minimal
FROM documents d LEFT JOIN a ON d.doc_id = a.comment_id LEFT JOIN b ON d.doc_id = b.comment_id""")
def join_originals_and_paths(spark, sf):
    originals = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"), "lang")
    return originals.join(path_a(spark, sf), "comment_id", "left").join(path_b(spark, sf), "comment_id", "left")


@query("members_with_features", "J3", f"""WITH {COMMENTS_SQL}, {B_SQL}
SELECT l.comment_id, l.label_id, coalesce(minimal, '') AS feature
FROM comments l LEFT JOIN b ON l.comment_id = b.comment_id""")
def members_with_features(spark, sf):
    return comments(spark, sf).select("comment_id", "label_id").join(path_b(spark, sf), "comment_id", "left").select(
        "comment_id", "label_id", F.coalesce("minimal", F.lit("")).alias("feature"))


@query("allow_list", "J5 U4", f"""WITH {COMMENTS_SQL}
SELECT comment_id, video_id FROM comments WHERE comment_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def allow_list(spark, sf):
    allowed = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("comment_id"))
    return texts(spark, sf).select("comment_id", "video_id").join(allowed, "comment_id", "left_semi")


EXCLUDED_SQL = """excluded AS (SELECT doc_id AS comment_id FROM documents WHERE lang = 'es'
  UNION SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 300)"""


def excluded(spark, sf):
    docs = table(spark, sf, "documents")
    i = F.col("doc_id").alias("comment_id")
    return union_all([
        docs.filter("lang = 'es'").select(i),
        table(spark, sf, "labels").filter("toxic = 1").select(i),
        docs.filter("n_chars < 300").select(i),
    ]).distinct()


@query("exclude_lists", "J6", f"""WITH {EXCLUDED_SQL}
SELECT doc_id AS comment_id, source AS video_id FROM documents WHERE doc_id NOT IN (SELECT comment_id FROM excluded)""")
def exclude_lists(spark, sf):
    return texts(spark, sf).select("comment_id", "video_id").join(excluded(spark, sf), "comment_id", "left_anti")


@query("union_of_id_lists", "U2", f"WITH {EXCLUDED_SQL} SELECT comment_id FROM excluded")
def union_of_id_lists(spark, sf):
    return excluded(spark, sf)


@query("human_and_model_labels", "J7", f"""WITH {LABELLED_SQL}, {EXCLUDED_SQL}
SELECT l.comment_id, l.label_id, l.human_id FROM labelled l JOIN excluded e ON l.comment_id = e.comment_id""")
def human_and_model_labels(spark, sf):
    return labelled(spark, sf).select("comment_id", "label_id", "human_id").join(excluded(spark, sf), "comment_id")


@query("terms_in_class_and_overall", "J8", f"""WITH {LABELLED_SQL},
t AS (SELECT label_id, unnest({st.words(st.clean_aggressive('text'))}) AS token FROM labelled),
o AS (SELECT token, count(*) AS n_all FROM t GROUP BY 1), c AS (SELECT label_id, token, count(*) AS n_in FROM t GROUP BY 1, 2)
SELECT c.label_id, c.token, n_in, n_all FROM c JOIN o ON c.token = o.token WHERE n_all >= 5""")
def terms_in_class_and_overall(spark, sf):
    words = labelled(spark, sf).select("label_id", F.explode(tx.tokens(tx.clean_aggressive("text"))).alias("token"))
    per_class = words.groupBy("label_id", "token").agg(F.count("*").alias("n_in"))
    # Both sides are already one row per term, so no word is hot any more.
    overall = per_class.groupBy("token").agg(F.sum("n_in").alias("n_all")).filter("n_all >= 5")
    return per_class.join(overall, "token")


@query("label_override", "J9", f"""WITH {CORRECTIONS_SQL}
SELECT l.comment_id, CASE WHEN c.comment_id IS NULL THEN l.label_id ELSE c.label_id END AS label_id
FROM labelled l LEFT JOIN corrections c ON l.comment_id = c.comment_id""")
def label_override(spark, sf):
    return apply_updates(
        labelled(spark, sf).select("comment_id", "label_id"), corrections(spark, sf), "comment_id", ["label_id"])


@query("apply_corrections", "J10", f"""WITH {CORRECTIONS_SQL}
SELECT l.comment_id, coalesce(c.label_id, l.label_id) AS label_id, coalesce(c.confidence, l.confidence) AS confidence,
  c.comment_id IS NOT NULL AS verified FROM labelled l LEFT JOIN corrections c ON l.comment_id = c.comment_id""")
def apply_corrections(spark, sf):
    base = labelled(spark, sf).select("comment_id", "label_id", "confidence")
    return apply_updates(base, corrections(spark, sf), "comment_id", ["label_id", "confidence"], "verified")


@query("candidate_index_join", "J12 S5", """WITH c AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx
  FROM events WHERE event_type = 'view'),
o AS (SELECT user_id AS idx, max(value) AS score FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT c.event_id, c.idx, o.score, o.idx IS NULL AS missing FROM c LEFT JOIN o ON c.idx = o.idx""")
def candidate_index_join(spark, sf):
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").select("event_id")
    bucketed = with_quantile_bucket(views, "event_id")
    numbered = exact_rank(bucketed, [], F.col("_quantile"), [F.asc("event_id")], "idx").drop("_quantile")
    numbered = numbered.withColumn("idx", F.col("idx") - 1)
    batch = events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("idx")).agg(
        F.max("value").alias("score"), F.lit(True).alias("found"))
    return numbered.join(batch, "idx", "left").select(
        "event_id", "idx", "score", F.col("found").isNull().alias("missing"))


@query("missing_metadata", "J13", """SELECT doc_id AS comment_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_metadata(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"))
    meta = table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"))
    return upsert.missing_rows(ids, meta, "comment_id")


@query("found_metadata", "J13", """SELECT l.doc_id AS comment_id, d.source AS video_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def found_metadata(spark, sf):
    """Every labelled id has its metadata; a lost one would fail the query."""
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"))
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"), F.col("source").alias("video_id"))
    return upsert.all_found(ids, meta, "comment_id")


@query("union_of_parts", "U1", """SELECT 'order' AS part, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier""")
def union_of_parts(spark, sf):
    def part(name, df, key):
        return df.select(F.lit(name).alias("part"), F.col(key).alias("id"))

    return union_all([
        part("order", table(spark, sf, "orders").filter("o_orderstatus = 'P'"), "o_orderkey"),
        part("customer", table(spark, sf, "customer"), "c_custkey"),
        part("supplier", table(spark, sf, "supplier"), "s_suppkey")])


@query("subset_changes", "U3", """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1),
b AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT doc_id AS comment_id, 'out' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
UNION ALL SELECT doc_id, 'in' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def subset_changes(spark, sf):
    i = F.col("doc_id").alias("comment_id")
    old = table(spark, sf, "labels").filter("quality = 1").select(i)
    new = table(spark, sf, "documents").filter("lang = 'en'").select(i)
    return upsert.set_difference(old, new, "comment_id")


@query("labels_with_rows", "U4", "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr'")
def labels_with_rows(spark, sf):
    french = table(spark, sf, "documents").filter("lang = 'fr'").select("doc_id")
    return table(spark, sf, "labels").select("doc_id").intersect(french)
