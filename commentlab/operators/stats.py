"""Corpus statistics: one aggregate per report, no pass per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from ..functions.text import word_count
from .keyed import explode_rows, scalar_of, top_per_key


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def with_absent(counts: DataFrame, dim: DataFrame, col: str, n: str = "n") -> DataFrame:
    """Counts joined onto a small dimension, zero where a value does not occur."""
    return dim.join(counts, col, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("bigint")))


def length_profile(
    df: DataFrame, texts: dict[str, str], maxima: Sequence[str], digits: int = 2
) -> DataFrame:
    """Mean, median and maximum word counts of several text columns in one aggregate.

    Word counts are small whole numbers, so the exact median keeps one entry per length.
    """
    counted = df.select(*[word_count(c).alias(name) for name, c in texts.items()])
    return counted.agg(
        *[F.round(F.avg(n), digits).alias(f"avg_{n}") for n in texts],
        *[F.percentile(n, 0.5).cast("int").alias(f"median_{n}") for n in texts],
        *[F.max(n).alias(f"max_{n}") for n in maxima],
    )


def approximate_medians(df: DataFrame, texts: dict[str, str], accuracy: int = 100) -> DataFrame:
    """Medians within a rank error of 1/accuracy, all in one pass."""
    counted = df.select(*[word_count(c).alias(name) for name, c in texts.items()])
    return counted.agg(*[F.percentile_approx(n, 0.5, accuracy).alias(f"median_{n}") for n in texts])


def length_summary(df: DataFrame, text: str) -> DataFrame:
    n = word_count(text)
    return df.agg(
        F.round(F.avg(n), 6).alias("mean_words"),
        F.percentile(n, 0.5).alias("median_words"),
        F.percentile(n, 0.95).alias("p95_words"),
        F.max(n).alias("max_words"),
        F.count_if(n <= 1).alias("n_short"),
    )


def quality(df: DataFrame, feature: str, digits: int = 2) -> DataFrame:
    """Blank and repeated features; both shares are of all rows."""
    filled = F.length(F.trim(feature)) > 0
    counts = df.agg(
        F.count("*").alias("n_total"),
        F.count_if(~filled).alias("n_empty"),
        F.count_distinct(F.when(filled, F.md5(feature))).alias("_distinct"),
    )
    dup = F.col("n_total") - F.col("n_empty") - F.col("_distinct")
    rows = F.nullif("n_total", F.lit(0).cast("bigint"))
    return counts.select(
        "n_total",
        "n_empty",
        F.round(100 * F.col("n_empty") / rows, digits).alias("empty_pct"),
        dup.alias("n_duplicate"),
        F.round(100 * dup / rows, digits).alias("duplicate_pct"),
    )


def leakage(df: DataFrame, key: str, feature: str, fold: str) -> DataFrame:
    """Ids and texts that occur in more than one fold.

    Rows are first counted per (value, fold), so a text shared by many rows arrives at its
    final group as one row per fold.
    """

    def shared(rows: DataFrame) -> DataFrame:
        per_fold = rows.groupBy("_v", fold).agg(F.count("*").alias("_n"), F.max("_used").alias("_used"))
        return (
            per_fold.groupBy("_v")
            .agg(F.count("*").alias("_folds"), F.sum("_n").alias("_rows"), F.max("_used").alias("_used"))
            .filter((F.col("_folds") > 1) & F.col("_used"))
        )

    # Blank features are dropped after the count: a filter before it would move below the
    # projection and compute the feature a second time.
    filled = F.length(F.trim(feature)) > 0
    texts = shared(df.select(F.md5(feature).alias("_v"), fold, filled.alias("_used")))
    ids = shared(df.select(F.col(key).alias("_v"), fold, F.lit(True).alias("_used")))
    return texts.agg(
        F.count("*").alias("shared_texts"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_affected"),
    ).withColumn("id_overlap", scalar_of(ids, F.count("*")))


def vocabulary_size(words: DataFrame, token: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(token) if approximate else F.count_distinct(token)
    return words.agg(count.alias("vocab_size"))


def top_terms(words: DataFrame, token: str, n: int = 12) -> DataFrame:
    return (
        words.groupBy(token).agg(F.count("*").alias("n")).orderBy(F.desc("n"), token).limit(n)
    )


def term_class_counts(words: DataFrame, token: str, group: str, classes: int) -> DataFrame:
    """One row per term with its count in each class; the shuffle carries partial counts."""
    return words.groupBy(token).agg(
        F.count("*").alias("n_all"),
        *[F.count_if(F.col(group) == i).alias(f"n_{i}") for i in range(classes)],
    )


def lift(
    counts: DataFrame,
    token: str,
    sizes: Column,
    group: str,
    min_count: int,
    n: int = 12,
    classes: int = len(LABELS),
) -> DataFrame:
    """The ``n`` terms of each class most over-represented there.

    ``counts`` comes from ``term_class_counts``; ``sizes`` is a struct of ``each``, the size of
    every class in the unit the counts are in, and ``grand``, their sum.
    """
    per_class = F.array(
        *[F.struct(F.lit(i).alias(group), F.col(f"n_{i}").alias("n_in")) for i in range(classes)]
    )
    long = (
        counts.filter(F.col("n_all") >= min_count)
        .select(token, "n_all", F.explode(per_class).alias("_c"))
        .select(token, "n_all", "_c.*")
        .filter(F.col("n_in") > 0)
    )
    share = F.col("n_in") / F.get(sizes["each"], F.col(group))
    scored = long.withColumn("lift", F.round(share / (F.col("n_all") / sizes["grand"]), 6))
    return top_per_key(scored, [group], [F.desc("lift"), F.asc(token)], n, "rank").select(
        group, "rank", token, "lift", "n_in"
    )


def _sizes(of: DataFrame, each: Sequence[Column], grand: Column) -> Column:
    """Class sizes as one scalar subquery."""
    return of.agg(F.struct(F.array(*each).alias("each"), grand.alias("grand")).alias("s")).scalar()


def class_terms(words: DataFrame, token: str, group: str, min_count: int = 5, n: int = 12) -> DataFrame:
    """Lift by occurrences: share of the class's words over share of all words."""
    counts = term_class_counts(words, token, group, len(LABELS))
    # Class sizes are sums of the very same columns, so both sides share one exchange and the
    # words are made only once.
    each = [F.sum(f"n_{i}") for i in range(len(LABELS))]
    return lift(counts, token, _sizes(counts, each, F.sum("n_all")), group, min_count, n)


def class_terms_by_document(
    docs: DataFrame, tokens: str, group: str, min_docs: int = 8, n: int = 12
) -> DataFrame:
    """Lift by documents: each document counts a word once."""
    words = explode_rows(docs, [group], F.array_distinct(tokens), "token")
    counts = term_class_counts(words, "token", group, len(LABELS))
    each = [F.count_if(F.col(group) == i) for i in range(len(LABELS))]
    return lift(counts, "token", _sizes(docs, each, F.count("*")), group, min_docs, n)


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.groupBy(old, new).agg(F.count("*").alias("n"))


def top_pairs(df: DataFrame, pair: str, n: int) -> DataFrame:
    return df.groupBy(pair).agg(F.count("*").alias("n")).orderBy(F.desc("n"), pair).limit(n)


def dominant(counts: DataFrame, name: str, n: str) -> DataFrame:
    """The most frequent value and its count; ties go to the first name."""
    return counts.orderBy(F.desc(n), F.asc(name)).limit(1).select(name, n)


def label_matrix(df: DataFrame, dim: DataFrame, actual: str, predicted: str, n: str) -> DataFrame:
    """Counts as a full square with one column per class, zero where nothing occurs."""
    wide = df.groupBy(actual).pivot(predicted, list(LABELS)).agg(F.sum(n))
    rows = dim.select(F.col("label").alias(actual))
    return rows.join(wide, actual, "left").select(
        actual, *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in LABELS]
    )


def balance_status(counts: DataFrame, name: str, n: str) -> DataFrame:
    """'balanced' if all classes have equal counts, else the largest and its lead."""
    pair = F.struct(F.col(n).alias("n"), F.col(name).alias("label"))
    ordered = F.sort_array(F.collect_list(pair), asc=False)  # one entry per class
    top, second = F.element_at("_o", 1), F.try_element_at("_o", F.lit(2))
    even = F.col("_min") == F.col("_max")
    return counts.agg(ordered.alias("_o"), F.min(n).alias("_min"), F.max(n).alias("_max")).select(
        F.when(even, "balanced").otherwise("dominant").alias("status"),
        F.when(~even, top["label"]).alias("label"),
        F.when(even, F.lit(0)).otherwise(top["n"] - F.coalesce(second["n"], F.lit(0))).alias("gap"),
    )


def confidence_histogram(
    df: DataFrame, bins_dim: DataFrame, value: str, correct: str, bins: int = 20
) -> DataFrame:
    """Rows per bin of [0, 1], right and wrong apart; empty bins show zero."""
    place = F.least(F.greatest(F.floor(F.col(value) * bins), F.lit(0)), F.lit(bins - 1))
    counts = df.groupBy(place.cast("int").alias("bin")).agg(
        F.count_if(F.col(correct)).alias("n_correct"), F.count_if(~F.col(correct)).alias("n_wrong")
    )
    zero = F.lit(0).cast("bigint")
    return bins_dim.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("n_correct", zero).alias("n_correct"),
        F.coalesce("n_wrong", zero).alias("n_wrong"),
    )


def parity(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How many rows two pipelines agree on; a missing value never agrees."""
    n = F.count("*")
    cols = [n.alias("n")]
    for name, (a, b) in pairs.items():
        same = F.count_if(F.col(a) == F.col(b))
        cols += [same.alias(f"{name}_equal"), F.round(F.try_divide(same, n), 6).alias(f"{name}_share")]
    return df.agg(*cols)
