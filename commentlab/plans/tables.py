"""Comment-shaped views over the given tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables whose rows are long texts, with a column that spreads them evenly.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts with work for every core.

    Cleaning text costs far more than reading it, so a table that comes in fewer splits than
    there are cores is spread first. One with enough splits is read as it is, with no shuffle.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    if df.select(TEXT_KEYS[name]).rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXT_KEYS[name])
    return df


# Class of a document from its two flags: toxic, else low quality, else good.
LABEL_SQL = "CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 WHEN l.quality = 1 THEN 2 END"

COMMENTS_SQL = f"""comments AS (
  SELECT d.doc_id AS comment_id, d.source AS video_id, d.text, d.lang, d.n_chars,
         {LABEL_SQL} AS label_id,
         (d.doc_id * 7919 % 1000) / 1000e0 AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# A second annotator who sees long or French texts differently.
LABELLED_SQL = (
    COMMENTS_SQL
    + """, labelled AS (
  SELECT *, CASE WHEN lang = 'fr' OR n_chars > 4000
                 THEN CASE label_id WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END
                 ELSE label_id END AS human_id
  FROM comments WHERE label_id IS NOT NULL)"""
)

# Class scores of a made-up model, spread over [0, 1).
SCORES_SQL = (
    COMMENTS_SQL
    + """, scores AS (
  SELECT comment_id, label_id,
         (comment_id * 7919 % 997) / 997e0 AS s0,
         ((comment_id * 6101 + 13) % 991) / 991e0 AS s1,
         ((comment_id * 4733 + 29) % 983) / 983e0 AS s2
  FROM comments WHERE label_id IS NOT NULL)"""
)

# Predictions that miss short texts.
PREDICTIONS_SQL = (
    LABELLED_SQL
    + """, predictions AS (
  SELECT comment_id, video_id, text, lang, confidence, label_id AS actual,
         CASE WHEN n_chars < 800 THEN CASE label_id WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END
              ELSE label_id END AS predicted
  FROM labelled)"""
)

LABEL_DIM_SQL = (
    "label_dim(label_id, label) AS (VALUES (0, 'Negatif'), (1, 'Netral'), (2, 'Positif'))"
)

NAME_SQL = "CASE {0} WHEN 0 THEN 'Negatif' WHEN 1 THEN 'Netral' WHEN 2 THEN 'Positif' END"


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(0, "Negatif"), (1, "Netral"), (2, "Positif")], "label_id int, label string"
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The comments without their labels, for queries that need none: no join."""
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").alias("comment_id"), F.col("source").alias("video_id"), "text", "lang", "n_chars",
        (F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)).alias("confidence"),
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    label = (
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("comment_id"),
        F.col("source").alias("video_id"),
        "text",
        "lang",
        "n_chars",
        label.alias("label_id"),
        (F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)).alias("confidence"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("label_id") == 0, 2).when(F.col("label_id") == 1, 0).otherwise(1)
    moved = (F.col("lang") == "fr") | (F.col("n_chars") > 4000)
    return (
        comments(spark, sf)
        .filter(F.col("label_id").isNotNull())
        .withColumn("human_id", F.when(moved, other).otherwise(F.col("label_id")))
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("comment_id")
    return (
        comments(spark, sf)
        .filter(F.col("label_id").isNotNull())
        .select(
            "comment_id",
            "label_id",
            (i * 7919 % 997 / F.lit(997.0)).alias("s0"),
            ((i * 6101 + 13) % 991 / F.lit(991.0)).alias("s1"),
            ((i * 4733 + 29) % 983 / F.lit(983.0)).alias("s2"),
        )
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    missed = F.when(F.col("label_id") == 0, 1).when(F.col("label_id") == 1, 2).otherwise(0)
    return labelled(spark, sf).select(
        "comment_id",
        "video_id",
        "text",
        "lang",
        "confidence",
        F.col("label_id").alias("actual"),
        F.when(F.col("n_chars") < 800, missed).otherwise(F.col("label_id")).alias("predicted"),
    )
