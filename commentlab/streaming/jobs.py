"""Incremental versions of the batch operators on Structured Streaming.

Every job can stop and start again: the checkpoint names what has been read, and each
micro-batch writes its own folder, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..functions.lexicons import SLANG, STOPWORDS
from ..operators.ingest import PAGE, flatten_pages
from ..operators.keyed import first_per_key, union_all
from ..operators.upsert import insert_new

PAGE_SCHEMA = f"video_id string, source_url string, source_title string, {PAGE}"


def answer_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Landed answer pages as they arrive."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def flat_comments(pages: DataFrame) -> DataFrame:
    """Comments of the arriving pages, blank ones dropped."""
    flat = flatten_pages(pages, "items", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return flat.filter(tx.squeeze("text") != "").drop("pos")


def _batch_path(target: str, batch: int) -> str:
    return f"{target}/batch={batch}"


def land_comments(comments: DataFrame, target: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Append each comment once: repeats within a batch and ids of earlier batches are skipped.

    Landed ids are kept beside the target, by a hash of the id in ``parts`` folders per batch. A
    batch reads only the folders that its own ids fall into.
    """
    known = f"{target.rstrip('/')}-ids"
    fields = "comment_id string, batch bigint, part int"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("comment_id"), F.lit(parts)).cast("int")
        batch = batch.persist()
        touched = [r["p"] for r in batch.select(part.alias("p")).distinct().collect()]  # ``parts`` at most
        # A folder of the ids exists from here on, so the read below is valid.
        batch.limit(0).select("comment_id").write.mode("ignore").parquet(f"{known}/batch=-1/part=-1")
        landed = spark.read.schema(fields).parquet(known)
        old = landed.filter((F.col("batch") < number) & F.col("part").isin(touched)).select("comment_id")
        insert_new(old, batch, "comment_id", [F.asc("video_id"), F.asc("raw_json")]).write.mode(
            "overwrite"
        ).parquet(_batch_path(target, number))
        added = spark.read.parquet(_batch_path(target, number)).select("comment_id", part.alias("part"))
        added.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{known}/batch={number}")
        batch.unpersist()

    return (
        comments.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def skip_repeats(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First row per key; keys are remembered for the watermark delay only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def _beside(target: str, name: str) -> str:
    return f"{target.rstrip('/')}-{name}"


def write_updates(counts: DataFrame, target: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Changed rows of a running aggregate, one folder per micro-batch.

    Each ``every`` batches the last value of every key is written as a snapshot, from the one before
    and the batches since; a row in ``-done`` then names it, so readers never see half of one.
    """
    keys = [c for c in counts.columns if c != "n"]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(target, number))
        if (number + 1) % every == 0:
            last = _last_values(batch.sparkSession, target, keys[0], number)
            last.write.mode("overwrite").parquet(f"{_beside(target, 'snapshots')}/upto={number}")
            done = batch.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("number"))
            done.write.mode("overwrite").parquet(f"{_beside(target, 'done')}/upto={number}")

    # The folder of the snapshots' names exists from here on.
    counts.sparkSession.range(0).select(F.col("id").alias("number")).write.mode("ignore").parquet(f"{_beside(target, 'done')}/upto=-1")
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def update_parts(spark: SparkSession, target: str, before: int | None = None) -> list[DataFrame]:
    """The newest snapshot (of batches before ``before``), if any, and the batches after it."""
    done = spark.read.schema("number bigint").parquet(_beside(target, "done"))
    done = done if before is None else done.filter(F.col("number") < before)
    last = done.agg(F.max("number")).first()[0]
    updates = spark.read.parquet(target)
    if last is None:
        return [updates]
    # Both filters are on folders, so older ones are not opened.
    snapshots = spark.read.parquet(_beside(target, "snapshots")).filter(F.col("upto") == last)
    return [snapshots.withColumn("batch", F.lit(last)).drop("upto"), updates.filter(F.col("batch") > last)]


def _last_values(spark: SparkSession, target: str, key: str, before: int | None = None) -> DataFrame:
    rows = union_all([p.withColumn("batch", F.col("batch").cast("bigint")) for p in update_parts(spark, target, before)])
    return first_per_key(rows, [key], [F.desc("batch")]).drop("batch")


def latest_counts(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last written value of each key. What is read does not grow with the number of batches: one
    snapshot and the batches since."""
    return _last_values(spark, target, key)


def clean_stream(
    stream: DataFrame,
    text: str,
    mapping: Mapping[str, str] = SLANG,
    stopwords: Sequence[str] = STOPWORDS,
    stems: Mapping[str, str] | None = None,
) -> DataFrame:
    """Both cleaned forms of each row, with the same expressions as in a batch.

    Stems are given as a small mapping, since a stream can not regroup words by row without
    state; a large stem table is applied when the batch is read.
    """
    words = tx.feature_tokens(text, mapping, stopwords)
    if stems:
        words = tx.replace_words(words, stems)
    return stream.withColumn("aggressive", F.array_join(words, " ")).withColumn(
        "minimal", tx.clean_minimal(text)
    )


def append_parquet(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
