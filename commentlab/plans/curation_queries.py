"""Annotation parsing, corrections, triage, agreement and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import curation, upsert
from ..operators.keyed import union_all
from ..operators.ranking import sample_exact
from . import sqltext as st
from .registry import query
from .relational_queries import CORRECTIONS_SQL, corrections
from .tables import (
    COMMENTS_SQL,
    LABEL_DIM_SQL,
    LABELLED_SQL,
    NAME_SQL,
    PREDICTIONS_SQL,
    SCORES_SQL,
    comments,
    label_dim,
    labelled,
    predictions,
    scores,
    table,
    texts,
)

NAME = NAME_SQL.format("label_id")
HUMAN = NAME_SQL.format("human_id")


def tasks(spark, sf):
    """Annotation exports as JSON text, made from the labelled comments, then read back.

    French tasks start with a cancelled annotation; Spanish ones only have another control;
    German ones first have a word that is no label, then the human label.
    """
    def annotation(cancelled, control, choice):
        value = F.struct(F.array(choice).alias("choices"))
        return F.struct(
            cancelled.alias("was_cancelled"),
            F.array(F.struct(F.lit(control).alias("from_name"), value.alias("value"))).alias("result"))

    llm, human = F.lower(lb.label_name("label_id")), F.upper(lb.label_name("human_id"))
    lang = F.col("lang")
    no = F.lit(False)
    lists = (
        F.when(lang == "fr", F.array(annotation(F.lit(True), "sentiment", llm), annotation(no, "sentiment", human)))
        .when(lang == "es", F.array(annotation(no, "other", llm), annotation(no, "other", human)))
        .when(lang == "de", F.array(annotation(no, "sentiment", F.lit("?")), annotation(no, "sentiment", human)))
        .otherwise(F.array(annotation(no, "sentiment", llm), annotation(no, "sentiment", human)))
    )
    data = F.struct(F.col("comment_id").cast("string").alias("comment_id"), "video_id", "text")
    text = labelled(spark, sf).select(F.to_json(F.struct(data.alias("data"), lists.alias("annotations"))).alias("j"))
    return text.select(F.from_json("j", curation.ANNOTATION_TASK).alias("t")).select("t.*")


@query("parse_annotations", "L1 S4 T23 G4", f"""WITH {LABELLED_SQL},
p AS (SELECT *, CASE WHEN lang IN ('fr', 'de') THEN human_id WHEN lang = 'es' THEN NULL ELSE label_id END AS c FROM labelled)
SELECT CAST(comment_id AS VARCHAR) AS comment_id, video_id, md5(text) AS text_md5, {NAME_SQL.format('c')} AS label, c AS label_id
FROM p WHERE c IS NOT NULL AND {st.squeeze('text')} <> ''""")
def parse_annotations(spark, sf):
    parsed = curation.parse_annotations(tasks(spark, sf), "sentiment", [F.asc("comment_id")])
    return parsed.withColumn("text_md5", F.md5("text")).drop("text")


@query("parse_last_annotation", "L2 S4", f"""WITH {LABELLED_SQL}
SELECT CAST(comment_id AS VARCHAR) AS comment_id, upper({HUMAN}) AS choice FROM labelled""")
def parse_last_annotation(spark, sf):
    choice = curation.last_choice("annotations")
    return tasks(spark, sf).select("data.comment_id", choice.alias("choice")).filter("choice IS NOT NULL")


# Verdicts of a reader: French texts are unreadable, the others get the human label.
VERDICT_SQL = f"""verdicts AS (SELECT comment_id, label_id, confidence,
  CASE WHEN lang = 'fr' THEN 'unreadable' WHEN lang = 'es' THEN 'later' ELSE {HUMAN} END AS choice FROM labelled),
triaged AS (SELECT comment_id, {NAME} AS label, confidence, choice,
  CASE WHEN choice = 'unreadable' THEN 'exclude' WHEN choice = 'later' THEN 'none'
       WHEN choice = {NAME} THEN 'confirm' ELSE 'correct' END AS verdict FROM verdicts)"""


def triaged(spark, sf):
    df = labelled(spark, sf)
    choice = F.when(F.col("lang") == "fr", "unreadable").when(F.col("lang") == "es", "later").otherwise(
        lb.label_name("human_id"))
    pool = df.select("comment_id", lb.label_name("label_id").alias("label"), "confidence")
    verdicts = df.select("comment_id", choice.alias("choice"))
    return curation.triage(pool, verdicts, "comment_id", "label", "unreadable")


@query("triage_verdicts", "L3", f"WITH {LABELLED_SQL}, {VERDICT_SQL} SELECT verdict, count(*) AS n FROM triaged GROUP BY 1")
def triage_verdicts(spark, sf):
    return triaged(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query("apply_triage", "L4", f"""WITH {LABELLED_SQL}, {VERDICT_SQL}
SELECT comment_id, CASE WHEN verdict = 'correct' THEN choice ELSE label END AS label, confidence,
  verdict IN ('confirm', 'correct') AS is_gold FROM triaged WHERE verdict <> 'exclude'""")
def apply_triage(spark, sf):
    return curation.apply_triage(triaged(spark, sf), "label")


READABLE_SQL = f"""(length({st.squeeze('text')}) >= 3 AND regexp_matches(text, '[A-Za-z]{{3,}}')
  AND length({st.gsub('text', r'[^\pL]', '')}) / greatest(length({st.gsub('text', f'[{st.SPACE}]', '')}), 1) >= 0.5)"""
BEST = "verified DESC, confidence DESC, comment_id"
REBUILD_SQL = f"""single AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY lower({st.squeeze('text')}) ORDER BY {BEST}) AS k FROM fixed) WHERE k = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {BEST}) AS r FROM single)
SELECT comment_id, label_id, confidence, verified FROM best WHERE r <= 30"""


@query("rebuild_balanced", "L5 T10 T11 G2 G3 J10", f"""WITH {CORRECTIONS_SQL},
fixed AS (SELECT l.comment_id, l.text, coalesce(c.label_id, l.label_id) AS label_id,
  coalesce(c.confidence, l.confidence) AS confidence, c.comment_id IS NOT NULL AS verified
  FROM labelled l LEFT JOIN corrections c ON l.comment_id = c.comment_id WHERE {READABLE_SQL}),
{REBUILD_SQL}""")
def rebuild_balanced(spark, sf):
    pool = labelled(spark, sf).select("comment_id", "text", "label_id", "confidence")
    return curation.rebuild_balanced(
        pool, corrections(spark, sf), "comment_id", "label_id", "confidence", "text", 30).drop("text")


@query("rebuild_from_master", "L6 U2", f"""WITH {LABELLED_SQL},
checked AS (SELECT comment_id FROM labelled WHERE lang = 'de' UNION SELECT comment_id FROM labelled WHERE n_chars > 5000),
fixed AS (SELECT comment_id, text, label_id, confidence, comment_id IN (SELECT comment_id FROM checked) AS verified
  FROM labelled WHERE {READABLE_SQL}), {REBUILD_SQL}""")
def rebuild_from_master(spark, sf):
    df = labelled(spark, sf)
    lists = [df.filter("lang = 'de'"), df.filter("n_chars > 5000")]
    checked = union_all([x.select("comment_id") for x in lists]).distinct()
    pool = df.filter(curation.tx.is_readable("text")).select("comment_id", "text", "label_id", "confidence")
    marked = curation.apply_updates(pool, checked, "comment_id", [], "verified")
    best = [F.desc("verified"), F.desc("confidence")]
    single = curation.dedup_by_text(marked, "text", "comment_id", best)
    return curation.balanced_subset(single, "label_id", "comment_id", "confidence", 30, "verified").drop("text")


@query("change_log", "L7 A14", f"""WITH {CORRECTIONS_SQL}
SELECT c.comment_id, l.label_id AS label_before, c.label_id AS label_after, l.label_id <> c.label_id AS changed
FROM corrections c LEFT JOIN (SELECT * FROM labelled WHERE confidence > 0.2) l ON c.comment_id = l.comment_id""")
def change_log(spark, sf):
    before = labelled(spark, sf).filter("confidence > 0.2").select("comment_id", F.col("label_id").alias("label_before"))
    after = corrections(spark, sf).select("comment_id", F.col("label_id").alias("label_after"))
    return after.join(before, "comment_id", "left").withColumn(
        "changed", F.col("label_before") != F.col("label_after"))


@query("label_provenance", "L8", f"""WITH {COMMENTS_SQL}
SELECT comment_id, CASE WHEN lang = 'de' THEN 'manual' WHEN label_id IS NOT NULL THEN 'llm' END AS label_source,
  CASE WHEN lang = 'de' THEN 'Netral' END AS manual_label FROM comments""")
def label_provenance(spark, sf):
    df = comments(spark, sf)
    manual = df.filter("lang = 'de'").select("comment_id", F.lit("Netral").alias("manual_label"))
    base = df.select("comment_id", "label_id", F.lit(None).cast("string").alias("label_source"))
    return curation.mark_provenance(base, manual, "comment_id", "label_id").drop("label_id")


@query("blind_tasks", "L9 K2", f"""WITH {LABELLED_SQL}
SELECT comment_id, video_id, md5(text) AS text_md5, {NAME} AS reference_label FROM labelled
ORDER BY md5('42:' || comment_id), comment_id LIMIT 60""")
def blind_tasks(spark, sf):
    picked = sample_exact(labelled(spark, sf), "comment_id", 60)
    blind = picked.select("comment_id", "video_id", F.md5("text").alias("text_md5"))
    reference = picked.select("comment_id", lb.label_name("label_id").alias("reference_label"))
    return blind.join(reference, "comment_id")


KAPPA_SQL = """c AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2),
t AS (SELECT sum(n) AS n FROM c), ra AS (SELECT a AS k, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b AS k, sum(n) AS n FROM c GROUP BY 1),
m AS (SELECT (SELECT coalesce(sum(n), 0) FROM c WHERE a = b) / t.n AS po,
  (SELECT coalesce(sum(ra.n / t.n * rb.n / t.n), 0) FROM ra JOIN rb ON ra.k = rb.k) AS pe, t.n FROM t),
k AS (SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement,
  CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM m)
SELECT n, agreement, kappa, CASE WHEN kappa < 0 THEN 'poor (lebih buruk dari acak)' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair'
  WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS band FROM k"""


@query("cohen_kappa", "L10 L11 L12", f"WITH {LABELLED_SQL}, pairs AS (SELECT human_id AS a, label_id AS b FROM labelled), {KAPPA_SQL}")
def cohen_kappa(spark, sf):
    return curation.cohen_kappa(labelled(spark, sf), "human_id", "label_id")


@query("class_agreement", "L11", f"""WITH {LABELLED_SQL}, {LABEL_DIM_SQL}
SELECT d.label_id, d.label, count(l.comment_id) AS n_human,
  round(100 * count(*) FILTER (l.label_id = l.human_id) / nullif(count(l.comment_id), 0), 1) AS agree_pct,
  round(100 * count(l.comment_id) / 1411, 1) AS progress_pct
FROM label_dim d LEFT JOIN labelled l ON l.human_id = d.label_id GROUP BY 1, 2""")
def class_agreement(spark, sf):
    return curation.class_agreement(labelled(spark, sf), "human_id", "label_id", label_dim(spark), 1411)


@query("agreement_bands", "L12", """SELECT l_orderkey, l_linenumber, CASE WHEN k < 0 THEN 'poor (lebih buruk dari acak)' WHEN k < 0.2 THEN 'slight'
  WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band
FROM (SELECT *, l_quantity / 40 - 0.25e0 AS k FROM lineitem)""")
def agreement_bands(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", lb.agreement_band(F.col("l_quantity") / 40 - F.lit(0.25)).alias("band"))


@query("disagreement_sample", "L13", f"""WITH {LABELLED_SQL}
SELECT comment_id, {HUMAN} AS human, {NAME} AS label FROM labelled WHERE human_id <> label_id ORDER BY comment_id LIMIT 8""")
def disagreement_sample(spark, sf):
    wrong = labelled(spark, sf).filter("human_id <> label_id").orderBy("comment_id").limit(8)
    return wrong.select("comment_id", lb.label_name("human_id").alias("human"), lb.label_name("label_id").alias("label"))


@query("review_queue", "L14", f"""WITH {PREDICTIONS_SQL}
SELECT comment_id, '{{"data":{{"comment_id":' || comment_id || ',"label":"' || {NAME_SQL.format('actual')}
  || '"}},"predictions":[{{"model_version":"v1","score":' || (CASE WHEN confidence = 0 THEN '0.0' ELSE CAST(confidence AS VARCHAR) END)
  || ',"result":[{{"from_name":"sentiment","value":{{"choices":["' || {NAME_SQL.format('predicted')} || '"]}}}}]}}]}}' AS task
FROM predictions WHERE actual <> predicted""")
def review_queue(spark, sf):
    rows = predictions(spark, sf).filter("actual <> predicted").select(
        "comment_id", lb.label_name("actual").alias("label"), lb.label_name("predicted").alias("guess"), "confidence")
    return rows.select("comment_id", curation.review_task(["comment_id", "label"], "guess", "confidence", "v1").alias("task"))


@query("match_tasks", "L15", """WITH tasks AS (SELECT doc_id AS comment_id, doc_id + 100000 AS task_id FROM labels),
done AS (SELECT doc_id + 100000 AS task_id FROM labels WHERE quality = 1)
SELECT CASE WHEN t.task_id IS NULL THEN 'missing' WHEN d.task_id IS NOT NULL THEN 'skipped' ELSE 'push' END AS state, count(*) AS n
FROM documents l LEFT JOIN tasks t ON l.doc_id = t.comment_id LEFT JOIN done d ON t.task_id = d.task_id GROUP BY 1""")
def match_tasks(spark, sf):
    """Labelled documents have tasks, good ones are done; the others have none."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"), (F.col("doc_id") + 100000).alias("task_id"), "quality")
    done = known.filter("quality = 1").select("task_id")
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"))
    states = curation.match_tasks(ids, known, done, "comment_id")
    return states.groupBy("state").agg(F.count("*").alias("n"))


@query("consensus_wrong", "L16", f"""WITH {SCORES_SQL}, v AS (
  SELECT comment_id, label_id, CASE WHEN s0 >= 0.5 THEN 0 WHEN s1 >= 0.5 THEN 1 ELSE 2 END AS p FROM scores
  UNION ALL SELECT comment_id, label_id, CASE WHEN s1 >= 0.5 THEN 1 WHEN s0 >= 0.5 THEN 0 ELSE 2 END FROM scores)
SELECT comment_id, label_id, CAST(min(p) AS INTEGER) AS predicted, count(*) AS n_models FROM v GROUP BY 1, 2
HAVING min(p) = max(p) AND min(p) <> label_id""")
def consensus_wrong(spark, sf):
    s = scores(spark, sf)
    a, b = F.col("s0") >= 0.5, F.col("s1") >= 0.5
    votes = s.select("comment_id", "label_id", F.explode(F.array(
        F.when(a, 0).when(b, 1).otherwise(2), F.when(b, 1).when(a, 0).otherwise(2))).alias("p"))
    return curation.consensus_wrong(votes, "comment_id", "p", "label_id")


# A table of processed comments (English and French) and fresh rows for it (French and German).
OLD_SQL = """old AS (SELECT doc_id AS comment_id, lang, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE lang IN ('en', 'fr')),
fresh AS (SELECT doc_id AS comment_id, upper(lang) AS lang FROM documents WHERE lang IN ('fr', 'de'))"""


def old_table(spark, sf):
    return table(spark, sf, "documents").filter("lang IN ('en', 'fr')").select(
        F.col("doc_id").alias("comment_id"), "lang", F.col("n_chars").cast("double").alias("score"))


def fresh_rows(spark, sf):
    return table(spark, sf, "documents").filter("lang IN ('fr', 'de')").select(
        F.col("doc_id").alias("comment_id"), F.upper("lang").alias("lang"))


@query("upsert_whole_rows", "K5", f"""WITH {OLD_SQL}
SELECT comment_id, lang, score FROM old WHERE comment_id NOT IN (SELECT comment_id FROM fresh)
UNION ALL SELECT comment_id, lang, NULL FROM fresh""")
def upsert_whole_rows(spark, sf):
    return upsert.replace_rows(old_table(spark, sf), fresh_rows(spark, sf), "comment_id")


@query("upsert_fields", "K6", f"""WITH {OLD_SQL}
SELECT coalesce(o.comment_id, f.comment_id) AS comment_id, coalesce(f.lang, o.lang) AS lang, o.score
FROM old o FULL JOIN fresh f ON o.comment_id = f.comment_id""")
def upsert_fields(spark, sf):
    return upsert.set_fields(old_table(spark, sf), fresh_rows(spark, sf), "comment_id")


@query("update_existing", "K7", f"""WITH {OLD_SQL}
SELECT o.comment_id, coalesce(f.lang, o.lang) AS lang, o.score FROM old o LEFT JOIN fresh f ON o.comment_id = f.comment_id""")
def update_existing(spark, sf):
    return curation.apply_updates(old_table(spark, sf), fresh_rows(spark, sf), "comment_id", ["lang"])


# Updates of customers by the event stream, where a user comes many times: the last one counts.
EVENT_SQL = """latest AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1),
held AS (SELECT c_custkey AS user_id, c_mktsegment AS kind, c_acctbal FROM customer WHERE c_custkey % 2 = 0)"""


def held_rows(spark, sf):
    return table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("kind"), "c_acctbal")


def event_updates(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), "event_id")


@query("upsert_repeated_keys", "K5", f"""WITH {EVENT_SQL}
SELECT user_id, kind, c_acctbal FROM held WHERE user_id NOT IN (SELECT user_id FROM latest)
UNION ALL SELECT user_id, kind, NULL FROM latest""")
def upsert_repeated_keys(spark, sf):
    new = event_updates(spark, sf)
    return upsert.replace_rows(held_rows(spark, sf), new, "user_id", [F.desc("event_id")]).drop("event_id")


@query("set_fields_repeated_keys", "K6", f"""WITH {EVENT_SQL}
SELECT coalesce(h.user_id, l.user_id) AS user_id, coalesce(l.kind, h.kind) AS kind, c_acctbal
FROM held h FULL JOIN latest l ON h.user_id = l.user_id""")
def set_fields_repeated_keys(spark, sf):
    new = event_updates(spark, sf)
    return upsert.set_fields(held_rows(spark, sf), new, "user_id", [F.desc("event_id")]).drop("event_id")


@query("update_repeated_keys", "K7 J10", f"""WITH {EVENT_SQL}
SELECT h.user_id, coalesce(l.kind, h.kind) AS kind, c_acctbal, l.user_id IS NOT NULL AS verified
FROM held h LEFT JOIN latest l ON h.user_id = l.user_id""")
def update_repeated_keys(spark, sf):
    return curation.apply_updates(
        held_rows(spark, sf), event_updates(spark, sf), "user_id", ["kind"], "verified", [F.desc("event_id")])


@query("insert_counts", "K8", """WITH n AS (SELECT DISTINCT user_id FROM events),
o AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT (SELECT count(*) FROM events) AS n_given, count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM o)) AS n_inserted,
  (SELECT count(*) FROM events) - count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM o)) AS n_skipped FROM n""")
def insert_counts(spark, sf):
    old = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return upsert.insert_report(old, table(spark, sf, "events").select("user_id"), "user_id")


@query("membership_counts", "K10", """WITH e AS (SELECT doc_id FROM documents WHERE lang = 'en'),
n AS (SELECT doc_id FROM documents WHERE n_chars > 1000)
SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM n)) AS n_cleared,
  (SELECT count(*) FROM n) AS n_set, count(*) FILTER (doc_id IN (SELECT doc_id FROM n)) AS n_kept FROM e""")
def membership_counts(spark, sf):
    docs = table(spark, sf, "documents")
    i = F.col("doc_id").alias("comment_id")
    members = docs.filter("lang = 'en'").select(F.lit("english").alias("subset"), i)
    return upsert.membership_report(members, "english", docs.filter("n_chars > 1000").select(i), "comment_id")


@query("subset_change_counts", "U3", """WITH e AS (SELECT doc_id FROM documents WHERE lang = 'en'),
n AS (SELECT doc_id FROM documents WHERE n_chars > 1000)
SELECT (SELECT count(*) FROM n WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS n_in,
  (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM n)) AS n_out""")
def subset_change_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return upsert.difference_report(
        docs.filter("lang = 'en'").select("doc_id"), docs.filter("n_chars > 1000").select("doc_id"), "doc_id")


@query("update_report", "K7 U4", f"""WITH {OLD_SQL}
SELECT count(*) AS n_labels, count(o.comment_id) AS n_matched, count(*) - count(o.comment_id) AS n_unmatched
FROM fresh f LEFT JOIN old o ON f.comment_id = o.comment_id""")
def update_report(spark, sf):
    return upsert.match_report(old_table(spark, sf), fresh_rows(spark, sf), "comment_id")


@query("insert_skipping_duplicates", "K8 G4", """WITH n AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)
SELECT n.user_id, n.event_id FROM n WHERE n.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def insert_skipping_duplicates(spark, sf):
    old = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    new = table(spark, sf, "events").select("user_id", "event_id")
    return upsert.insert_new(old, new, "user_id", [F.asc("event_id")])


@query("backfill_missing", "K9", f"""WITH {OLD_SQL}
SELECT doc_id AS comment_id, md5({st.clean_minimal('text')}) AS feature FROM documents
WHERE doc_id NOT IN (SELECT comment_id FROM old)""")
def backfill_missing(spark, sf):
    source = texts(spark, sf).select("comment_id", "text")
    todo = upsert.missing_rows(source, old_table(spark, sf), "comment_id")
    return todo.select("comment_id", F.md5(curation.tx.clean_minimal("text")).alias("feature"))


@query("set_membership", "K10", """SELECT 'english' AS subset, doc_id AS comment_id FROM documents WHERE lang = 'en' AND n_chars > 1000
UNION ALL SELECT 'good', doc_id FROM labels WHERE quality = 1""")
def set_membership(spark, sf):
    docs = table(spark, sf, "documents").filter("lang = 'en'")
    i = F.col("doc_id").alias("comment_id")
    good = table(spark, sf, "labels").filter("quality = 1").select(F.lit("good").alias("subset"), i)
    members = docs.select(F.lit("english").alias("subset"), i).unionByName(good)
    return upsert.set_membership(members, "english", docs.filter("n_chars > 1000").select(i), "comment_id")


@query("delete_keys", "K11", """SELECT 'documents' AS table_name, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_deleted,
  count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_left FROM documents
UNION ALL SELECT 'labels', count(*) FILTER (toxic = 1), count(*) FILTER (toxic <> 1) FROM labels""")
def delete_keys(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return upsert.delete_report({"documents": docs, "labels": labels}, labels.filter("toxic = 1"), "doc_id")


@query("rows_after_delete", "K11", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_after_delete(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1")
    return upsert.delete_keys(table(spark, sf, "documents").select("doc_id", "lang"), gone, "doc_id")
