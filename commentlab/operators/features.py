"""Bag-of-words features as a relation (document, term, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keyed import counted_rows, lookup, scalar_of


def term_counts(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(document, term, tf). A document's terms are counted inside its row: nothing is moved, and a
    task holds the terms of one document, not those of its whole part."""
    return counted_rows(docs, [key], terms)


def vocabulary(counts: DataFrame, min_df: int = 1, cap: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` documents, all of them unless a ``cap`` is asked for.

    ``counts`` comes from ``term_counts``. With a cap the terms with most uses stay; equal
    terms are taken in alphabetical order.
    """
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))
    kept = per_term.filter(F.col("df") >= min_df)
    return kept if cap is None else kept.orderBy(F.desc("uses"), "term").limit(cap)


def tfidf(
    docs: DataFrame,
    key: str,
    terms: str,
    min_df: int = 1,
    sublinear: bool = True,
    idf_plus_one: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """(document, term, tf, weight) with rows of length one.

    idf is ln((n+1)/(df+1)), plus one if asked. Spark joins the vocabulary by its size: by
    broadcast, else by term, where a frequent term's rows are split as skewed.
    """
    counts = term_counts(docs, key, terms)
    vocab = vocabulary(counts, min_df, cap).select("term", "df")
    n = scalar_of(docs, F.count("*"))
    tf = (1 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    idf = F.log((n + 1) / (F.col("df") + 1)) + (1 if idf_plus_one else 0)
    weighted = counts.join(vocab, "term").withColumn("_raw", tf * idf)
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key)))
    weight = F.when(norm > 0, F.col("_raw") / norm).otherwise(F.lit(0.0))
    return weighted.select(key, "term", "tf", F.round(weight, 6).alias("weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight N / (k * n) per class, so that all classes weigh the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    n, k = scalar_of(counts, F.sum("n")), scalar_of(counts, F.count("*"))
    return counts.select(label, "n", (n / (k * F.col("n"))).alias("weight"))


def add_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Each row with the weight of its class, looked up in one map of the classes."""
    return df.withColumn(out, lookup(class_weights(df, label), label, F.col("weight")))
