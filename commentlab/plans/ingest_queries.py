"""Landed answers, links and job bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import ingest
from .registry import query
from .tables import table

# Links of the test pages: the part after the host stands in for a video id.
PAGE_LINKS = (
    r"example\.com/([a-z]{2}/[0-9]{3})(?:[^0-9]|$)",
    r"example\.org/([a-z]{2}/[0-9]{3})(?:[^0-9]|$)",
    r"example\.net/([a-z]{2}/[0-9]{3})(?:[^0-9]|$)",
)
PAGE_ID = r"^(en|fr|de)/[0-9]{3}$"

LINK_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(trim(url), '{p}', 1), '')" for p in PAGE_LINKS) + ")"


@query("extract_ids", "I5 I6", f"""SELECT page_id, {LINK_SQL} AS video_id,
  coalesce(regexp_matches({LINK_SQL}, '{PAGE_ID}'), FALSE) AS valid FROM pages""")
def extract_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", lb.extract_id("url", PAGE_LINKS).alias("video_id")).withColumn(
        "valid", lb.is_valid_id("video_id", PAGE_ID))


@query("split_links", "I7", f"""WITH t AS (SELECT page_id, {LINK_SQL} AS video_id FROM pages),
v AS (SELECT *, coalesce(regexp_matches(video_id, '{PAGE_ID}'), FALSE) AS ok FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ok ORDER BY page_id) AS k FROM v)
SELECT page_id, video_id, CASE WHEN NOT ok THEN 'INVALID' WHEN k = 1 THEN 'VALID' ELSE 'DUPLIKAT' END AS status FROM r""")
def split_links(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    return ingest.split_links(urls, "url", "page_id", PAGE_LINKS, PAGE_ID).drop("url")


def answer_pages(spark, sf):
    """One answer per conversation turn, as JSON: a full item and an empty one.

    The item has fields without a column, a count with a fraction and one beyond 32 bits.
    """
    t = table(spark, sf, "conversations")
    snippet = F.struct(
        F.col("text").alias("textDisplay"), F.upper("role").alias("textOriginal"),
        F.col("role").alias("authorDisplayName"),
        F.when(F.col("role") == "user", F.struct(F.concat(F.lit("ch"), F.col("conv_id")).alias("value"))).alias("authorChannelId"),
        F.when(F.col("role") == "user", F.col("turn").cast("string")).otherwise("4.2").alias("likeCount"),
        F.lit(True).alias("isPublic"),
        F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.lit(True).alias("canRate"))
    top = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), snippet.alias("snippet"))
    item = F.struct(
        F.lit("e1").alias("etag"), F.concat(F.lit("kind-"), F.col("role")).alias("kind"),
        F.struct((F.col("turn") * 2 + 3_000_000_000.5).alias("totalReplyCount"), top.alias("topLevelComment")).alias("snippet"))
    body = F.concat(F.lit('{"items":['), F.to_json(item), F.lit(',{"etag":"e2"}]}'))
    return t.select(
        F.concat(F.lit("v"), F.col("conv_id")).alias("video_id"), F.lit("u").alias("source_url"),
        F.lit(None).cast("string").alias("source_title"), body.alias("body"))


@query("flatten_answers", "I1 I2", """WITH b AS (SELECT 'v' || conv_id AS video_id, conv_id || '-' || turn AS cid, * FROM conversations)
SELECT cid AS comment_id, video_id, md5(text) AS text_md5, upper(role) AS text_original, role AS author_display_name,
  CASE WHEN role = 'user' THEN 'ch' || conv_id END AS author_channel_id,
  CAST(CASE WHEN role = 'user' THEN turn ELSE 0 END AS BIGINT) AS like_count, CAST(turn * 2 + 3000000000 AS BIGINT) AS total_reply_count,
  '2024-01-01T00:00:00Z' AS published_at, CAST(NULL AS VARCHAR) AS updated_at, TRUE AS can_rate, 'e1' AS etag, 'kind-' || role AS raw_kind, 'true' AS raw_public FROM b
UNION ALL SELECT '', video_id, md5(''), '', NULL, NULL, 0, 0, NULL, NULL, NULL, 'e2', NULL, NULL FROM b""")
def flatten_answers(spark, sf):
    pages = answer_pages(spark, sf).withColumn("page", F.from_json("body", ingest.PAGE))
    flat = ingest.flatten_pages(pages, "page.items", "2024-01-01T00:00:00")
    return flat.select(
        "comment_id", "video_id", F.md5("text").alias("text_md5"), "text_original", "author_display_name",
        "author_channel_id", "like_count", "total_reply_count", "published_at", "updated_at", "can_rate", "etag",
        F.get_json_object("raw_json", "$.kind").alias("raw_kind"),
        F.get_json_object("raw_json", "$.snippet.topLevelComment.snippet.isPublic").alias("raw_public"))


@query("keep_arrivals", "I3", """SELECT video_id, comment_id FROM (SELECT source AS video_id, doc_id AS comment_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id % 7 <> 0 AND trim(text) <> '') WHERE r <= 25""")
def keep_arrivals(spark, sf):
    """Some texts are nothing but white space and take up no place."""
    text = F.when(F.col("doc_id") % 7 == 0, " \t\n\u00a0").otherwise(F.col("text")).alias("text")
    df = table(spark, sf, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("comment_id"), text)
    return ingest.keep_arrivals(df, "video_id", "text", [F.asc("comment_id")], 25).drop("text")


@query("classify_answers", "I4", """WITH k AS (SELECT event_type, CAST(props->>'k' AS INTEGER) AS k FROM events)
SELECT CASE WHEN event_type = 'error' AND k < 30 THEN 'quota' WHEN event_type = 'error' AND k < 60 THEN 'quota'
  WHEN event_type = 'error' THEN 'forbidden' WHEN event_type = 'signup' THEN 'error' ELSE 'ok' END AS outcome, count(*) AS n
FROM k GROUP BY 1""")
def classify_answers(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    status = F.when(kind == "error", 403).when(kind == "signup", 500).otherwise(200)
    reason = F.when(k < 30, "quotaExceeded").when(k < 60, "dailyLimitExceeded").otherwise("forbidden")
    reasons = F.when(kind == "error", F.array(F.lit("other"), reason))
    return table(spark, sf, "events").select(lb.response_class(status, reasons).alias("outcome")).groupBy(
        "outcome").agg(F.count("*").alias("n"))


# The event table as a log of jobs, one job per user.
LOG_SQL = """log AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id AS video_id, CASE event_type WHEN 'signup' THEN 'registered' WHEN 'click' THEN 'running'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'title' END AS kind, CAST(floor(value) AS BIGINT) AS amount FROM events)"""
STATE_SQL = LOG_SQL + """, state AS (SELECT video_id,
  coalesce(arg_max(CASE WHEN kind = 'registered' THEN 'pending' ELSE kind END, event_id) FILTER (kind <> 'title'), 'pending') AS status,
  max(ts) FILTER (kind = 'running') AS started_at, max(ts) FILTER (kind IN ('completed', 'failed')) AS completed_at,
  coalesce(arg_max(amount, event_id) FILTER (kind = 'completed'), 0) AS comment_count,
  CASE WHEN arg_max(kind, event_id) FILTER (kind IN ('completed', 'failed')) = 'failed' THEN 'HTTP 403' END AS error_message,
  'title ' || arg_max(amount, event_id) FILTER (kind = 'title') AS video_title FROM log GROUP BY 1)"""


def job_log(spark, sf):
    kinds = {"signup": "registered", "click": "running", "purchase": "completed", "error": "failed"}
    kind = F.lit("title")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    amount = F.floor("value")
    return table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("user_id").alias("video_id"), kind.alias("kind"), amount.alias("amount"),
        F.lit("HTTP 403").alias("message"), F.concat(F.lit("title "), amount).alias("title"))


def job_table(spark, sf):
    return ingest.job_state(job_log(spark, sf), "video_id", "kind", "ts", "event_id")


@query("job_state", "I9", f"WITH {STATE_SQL} SELECT * FROM state")
def job_state(spark, sf):
    return job_table(spark, sf)


@query("register_jobs", "I8", f"""WITH {STATE_SQL}, e AS (SELECT c_custkey AS video_id, 'u' || c_custkey AS url FROM customer WHERE c_acctbal > 0)
SELECT coalesce(s.video_id, e.video_id) AS video_id, CASE WHEN s.video_id IS NULL THEN e.url ELSE 'old' END AS video_url,
  CASE WHEN s.video_id IS NULL THEN NULL ELSE s.video_title END AS video_title,
  CASE WHEN s.video_id IS NULL OR (s.status = 'failed' AND e.video_id IS NOT NULL) THEN 'pending' ELSE s.status END AS status,
  CASE WHEN s.video_id IS NULL OR (s.status = 'failed' AND e.video_id IS NOT NULL) THEN 0 ELSE s.comment_count END AS comment_count,
  CASE WHEN NOT (s.status = 'failed' AND e.video_id IS NOT NULL) THEN s.started_at END AS started_at,
  CASE WHEN NOT (s.status = 'failed' AND e.video_id IS NOT NULL) THEN s.completed_at END AS completed_at,
  CASE WHEN NOT (s.status = 'failed' AND e.video_id IS NOT NULL) THEN s.error_message END AS error_message
FROM state s FULL JOIN e ON s.video_id = e.video_id""")
def register_jobs(spark, sf):
    jobs = job_table(spark, sf).withColumn("video_url", F.lit("old"))
    entries = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("video_id"), F.concat(F.lit("u"), "c_custkey").alias("video_url"),
        F.lit(None).cast("string").alias("video_title"))
    return ingest.register_jobs(jobs, entries)


@query("pending_jobs", "I10", f"WITH {STATE_SQL} SELECT video_id, status FROM state WHERE status = 'pending' ORDER BY video_id")
def pending_jobs(spark, sf):
    return job_table(spark, sf).filter("status = 'pending'").select("video_id", "status").orderBy("video_id")


@query("all_jobs", "I10", f"WITH {STATE_SQL} SELECT video_id, status, comment_count FROM state ORDER BY video_id")
def all_jobs(spark, sf):
    return job_table(spark, sf).select("video_id", "status", "comment_count").orderBy("video_id")


@query("job_status_counts", "I11 A2", f"""WITH {STATE_SQL}, dim(status) AS (VALUES ('pending'), ('running'), ('completed'), ('failed'))
SELECT d.status, count(s.video_id) AS n FROM dim d LEFT JOIN state s ON s.status = d.status GROUP BY 1""")
def job_status_counts(spark, sf):
    return ingest.status_counts(job_table(spark, sf), ingest.status_dim(spark))


@query("resume_plan", "I12", f"""WITH {STATE_SQL},
e AS (SELECT c_custkey AS video_id, CASE WHEN c_acctbal < -900 THEN 'quota' WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END AS outcome FROM customer),
m AS (SELECT e.*, s.video_id IS NOT NULL AS done FROM e LEFT JOIN (SELECT * FROM state WHERE status = 'completed') s ON e.video_id = s.video_id),
w AS (SELECT *, coalesce(max(CASE WHEN NOT done AND outcome = 'quota' THEN 1 ELSE 0 END) OVER (
  ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM m)
SELECT video_id, video_id AS position, CASE WHEN done THEN 'skipped_completed' WHEN outcome = 'quota' THEN 'quota_exceeded'
  WHEN outcome = 'ok' THEN 'completed' ELSE 'failed' END AS result FROM w WHERE stopped = 0""")
def resume_plan(spark, sf):
    outcome = F.when(F.col("c_acctbal") < -900, "quota").when(F.col("c_acctbal") < 0, "error").otherwise("ok")
    entries = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("video_id"), F.col("c_custkey").alias("position"), outcome.alias("outcome"))
    completed = job_table(spark, sf).filter("status = 'completed'")
    return ingest.resume_plan(entries, completed, "outcome", "position")
