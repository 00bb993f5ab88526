"""Landed service answers to flat rows, and the state of ingest jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.lexicons import JOB_STATUSES
from ..functions.text import is_blank
from .keyed import explode_rows, first_per_key, scalar_of, top_per_key

# Fields of a comment item; numbers may arrive as text, so counts keep their JSON type.
ITEM = (
    "struct<etag:string, snippet:struct<totalReplyCount:variant, topLevelComment:struct<id:string, "
    "snippet:struct<textDisplay:string, textOriginal:string, authorDisplayName:string, "
    "authorProfileImageUrl:string, authorChannelUrl:string, authorChannelId:struct<value:string>, "
    "likeCount:variant, publishedAt:string, updatedAt:string, videoOwnerChannelId:string, "
    "canRate:variant, viewerRating:string>>>>"
)
# Items are kept whole, with the fields that no column is made of.
PAGE = "items array<variant>"


def flatten_pages(pages: DataFrame, items: str, fetched_at: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """One row per item. Missing ids and texts become '', counts 0, all else NULL.

    ``raw_json`` has all of the item, also the fields without a column.
    """
    at = F.lit(fetched_at) if isinstance(fetched_at, str) else fetched_at
    page = ["video_id", "source_url", "source_title", at.alias("fetched_at"), *keep]
    rows = explode_rows(pages, page, items, "_raw", "pos").withColumn("_item", F.try_variant_get("_raw", "$", ITEM))
    thread = F.col("_item.snippet")
    top = thread["topLevelComment"]
    s = top["snippet"]
    return rows.select(
        F.coalesce(top["id"], F.lit("")).alias("comment_id"),
        "video_id",
        F.coalesce(s["textDisplay"], F.lit("")).alias("text"),
        F.coalesce(s["textOriginal"], F.lit("")).alias("text_original"),
        s["authorDisplayName"].alias("author_display_name"),
        s["authorProfileImageUrl"].alias("author_profile_image"),
        s["authorChannelUrl"].alias("author_channel_url"),
        s["authorChannelId"]["value"].alias("author_channel_id"),
        lb.safe_int_of(s["likeCount"]).alias("like_count"),
        lb.safe_int_of(thread["totalReplyCount"]).alias("total_reply_count"),
        s["publishedAt"].alias("published_at"),
        s["updatedAt"].alias("updated_at"),
        "source_url",
        "source_title",
        s["videoOwnerChannelId"].alias("video_owner_channel_id"),
        F.try_variant_get(s["canRate"], "$", "boolean").alias("can_rate"),
        s["viewerRating"].alias("viewer_rating"),
        F.col("_item.etag").alias("etag"),
        "fetched_at",
        F.to_json("_raw").alias("raw_json"),
        *keep,
        "pos",
    )


def keep_arrivals(df: DataFrame, video: str, text: str, order: Sequence[Column], n: int) -> DataFrame:
    """Rows with text, at most ``n`` per video in order of arrival."""
    return top_per_key(df.filter(~is_blank(text)), [video], order, n)


def split_links(df: DataFrame, url: str, position: str, patterns: Sequence[str], id_pattern: str) -> DataFrame:
    """Each link with its id and whether it is valid, invalid or a repeat of an earlier one.

    The first position per id is found by a map-side limited rank and joined back on the
    unique (id, position), so a link that occurs very often does not fill one task.
    """
    tagged = df.withColumn("video_id", lb.extract_id(url, patterns))
    tagged = tagged.withColumn("_ok", lb.is_valid_id("video_id", id_pattern))
    firsts = first_per_key(
        tagged.filter("_ok").select("video_id", position), ["video_id"], [F.asc(position)]
    ).withColumn("_first", F.lit(True))
    status = (
        F.when(~F.col("_ok"), "INVALID").when(F.col("_first"), "VALID").otherwise("DUPLIKAT")
    )
    return (
        tagged.join(firsts, ["video_id", position], "left").withColumn("status", status).drop("_ok", "_first")
    )


def register_jobs(jobs: DataFrame, entries: DataFrame, reset_failed: bool = True) -> DataFrame:
    """Unknown videos become pending; failed ones start over; all others stay as they are."""
    new = entries.select(
        "video_id", F.col("video_url").alias("_url"), F.col("video_title").alias("_title"), F.lit(True).alias("_in")
    )
    both = jobs.withColumn("_old", F.lit(True)).join(new, "video_id", "full_outer")
    fresh = F.col("_old").isNull()
    reset = (F.col("status") == "failed") & F.col("_in").isNotNull() & F.lit(reset_failed)
    clear = fresh | F.coalesce(reset, F.lit(False))

    def cleared(column: str) -> Column:
        return F.when(~clear, F.col(column)).alias(column)

    return both.select(
        "video_id",
        F.when(fresh, F.coalesce("_url", F.lit(""))).otherwise(F.col("video_url")).alias("video_url"),
        F.when(fresh, F.col("_title")).otherwise(F.col("video_title")).alias("video_title"),
        F.when(clear, "pending").otherwise(F.col("status")).alias("status"),
        F.when(clear, F.lit(0).cast("bigint")).otherwise(F.col("comment_count")).alias("comment_count"),
        cleared("started_at"),
        cleared("completed_at"),
        cleared("error_message"),
    )


def job_state(log: DataFrame, video: str, kind: str, at: str, seq: str) -> DataFrame:
    """Current state per video from a log of registered / running / completed / failed / title.

    Each field is that of the latest entry which sets it.
    """
    when = F.struct(at, seq)

    def latest(value: Column, *kinds: str) -> Column:
        return F.max_by(value, F.when(F.col(kind).isin(*kinds), when))

    status = F.when(F.col(kind) == "registered", "pending").otherwise(F.col(kind))
    error = F.when(F.col(kind) == "failed", F.col("message"))
    return log.groupBy(video).agg(
        F.coalesce(latest(status, "registered", "running", "completed", "failed"), F.lit("pending")).alias("status"),
        latest(F.col(at), "running").alias("started_at"),
        latest(F.col(at), "completed", "failed").alias("completed_at"),
        F.coalesce(latest(F.col("amount"), "completed"), F.lit(0)).cast("bigint").alias("comment_count"),
        latest(error, "completed", "failed").alias("error_message"),
        F.max_by("title", F.when((F.col(kind) == "title") & F.col("title").isNotNull(), when)).alias("video_title"),
    )


def status_dim(spark) -> DataFrame:
    return spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string")


def status_counts(jobs: DataFrame, dim: DataFrame) -> DataFrame:
    counts = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return dim.join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def resume_plan(entries: DataFrame, completed: DataFrame, outcome: str, position: str) -> DataFrame:
    """What a run does with each entry: skip the completed, stop after the first quota error.

    ``outcome`` is what the service would answer. Entries after the stop are left out. The
    stop is one minimum over the work list, not a running value over all of it.
    """
    done = completed.select("video_id", F.lit(True).alias("_done"))
    marked = entries.join(done, "video_id", "left")
    work = marked.filter(F.col("_done").isNull() & (F.col(outcome) == "quota"))
    stop = scalar_of(work, F.min(position))
    result = (
        F.when(F.col("_done"), "skipped_completed")
        .when(F.col(outcome) == "quota", "quota_exceeded")
        .when(F.col(outcome) == "ok", "completed")
        .otherwise("failed")
    )
    reached = stop.isNull() | (F.col(position) <= stop)
    return marked.filter(reached).select("video_id", position, result.alias("result"))
