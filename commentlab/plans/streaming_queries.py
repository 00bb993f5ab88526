"""Streams over the given tables, run until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..streaming import jobs
from . import sqltext as st
from .ingest_queries import answer_pages
from .registry import query
from .tables import table
from .text_queries import DEMO_SLANG, DEMO_STOPWORDS


def table_stream(spark, sf, name):
    """New files of a table, which is one file or a folder of files. A stream takes a single file only as a match of a pattern."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_landing", "X1 X2 K8 I1", """SELECT conv_id || '-' || turn AS comment_id, 'v' || conv_id AS video_id, md5(text) AS text_md5
FROM conversations WHERE trim(text) <> ''""")
def stream_landing(spark, sf):
    """Answer files land twice over; each comment is kept once."""
    pages, target = new_path(spark, "pages"), new_path(spark, "landed")
    answers = answer_pages(spark, sf).select(
        F.regexp_replace(F.to_json(F.struct("video_id", "source_url")), r"\}$", ",").alias("head"), F.expr("substring(body, 2)").alias("tail"))
    lines = answers.select(F.concat("head", "tail").alias("value"))
    for _ in range(2):
        lines.repartition(4, "value").write.mode("append").text(pages)
    comments = jobs.flat_comments(jobs.answer_stream(spark, pages, files_per_batch=4))
    jobs.land_comments(comments, target, new_path(spark, "checkpoint")).awaitTermination()
    landed = spark.read.parquet(target)
    return landed.select("comment_id", "video_id", F.md5("text").alias("text_md5"))


@query("stream_skip_repeats", "X2", "SELECT event_id, user_id, event_type, value FROM events")
def stream_skip_repeats(spark, sf):
    """The events land twice over within a watermark of one hour; each is kept once, whole."""
    landing, target = new_path(spark, "events"), new_path(spark, "once")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        events.repartition(2, "event_id").write.mode("append").parquet(landing)
    stream = spark.readStream.schema(events.schema).parquet(landing)
    once = jobs.skip_repeats(stream, "event_id", "ts", "1 hour").select("event_id", "user_id", "event_type", "value")
    jobs.append_parquet(once, target, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target)


@query("stream_running_counts", "X3 I11 I13", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark, sf):
    target = new_path(spark, "counts")
    counts = jobs.running_counts(table_stream(spark, sf, "events"), "event_type")
    jobs.write_updates(counts, target, new_path(spark, "checkpoint")).awaitTermination()
    return jobs.latest_counts(spark, target, "event_type")


@query("stream_cleaning", "X4 T1 T2 T7", f"""SELECT doc_id, {st.join_words(st.replace_words(st.feature_words('text', DEMO_SLANG, DEMO_STOPWORDS), {'les': 'le', 'des': 'de'}))} AS aggressive,
  {st.clean_minimal('text')} AS minimal FROM documents""")
def stream_cleaning(spark, sf):
    target = new_path(spark, "clean")
    docs = table_stream(spark, sf, "documents").select("doc_id", "text")
    clean = jobs.clean_stream(docs, "text", DEMO_SLANG, DEMO_STOPWORDS, {"les": "le", "des": "de"})
    jobs.append_parquet(clean.drop("text"), target, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target)
