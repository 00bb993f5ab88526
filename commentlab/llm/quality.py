"""Quality rules: counts of a text, and a hashed n-gram model of trusted against raw texts.

The model has two multinomials over hashed word unigrams and bigrams, one counted over trusted
documents, one over the whole corpus. A document's score is the mean log-likelihood ratio of
its n-grams. Every document is judged by the same fixed threshold.

Defined cases: a null text has no words and is rejected; ids may be null or repeated, each row is
judged on its own; other columns are carried along or ignored; without documents, or without
trusted ones, the ratio of every n-gram is 0 and only the base rules reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.session import materialize

from .common import BLANKS, free_name, let, whole, words

GRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

BUCKETS = 1 << 15
SMOOTHING = 1.0
# Mean log-likelihood ratio that a document must reach, in nats per n-gram.
THRESHOLD = -0.5
# Trusted documents that are counted at most, those with the smallest id hash first.
TRUSTED_ROWS = 20_000


def grams_at(w: Column, i: Column) -> Column:
    return F.slice(w, i + 1, GRAM)


def repeated_words(w: Column) -> Column:
    """Words inside windows of ``GRAM`` words that the text holds twice or more.

    Windows are hashed first; only those whose hash repeats are compared as words.
    """
    places = F.sequence(F.lit(0), F.size(w) - GRAM)

    def twins(rows: Column) -> Column:
        alike = lambda x, i, j: F.coalesce(F.get(rows, j)["gram"] == x["gram"], F.lit(False))
        kept = F.filter(rows, lambda x, i: alike(x, i, i - 1) | alike(x, i, i + 1))
        return F.transform(kept, lambda x: x["at"])

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(at), start,
            lambda a, i: F.struct(
                (a["n"] + i + GRAM - F.greatest(i, a["end"])).alias("n"), (i + GRAM).alias("end")
            ),
            lambda a: a["n"],
        )

    def by_words(at: Column) -> Column:
        rows = F.transform(at, lambda i: F.struct(grams_at(w, i).alias("gram"), i.alias("at")))
        return let(F.sort_array(rows), lambda r: covered(twins(r)))

    def by_hash(h: Column) -> Column:
        rows = F.transform(h, lambda x, i: F.struct(x.alias("gram"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.sort_array(rows), lambda r: let(twins(r), by_words))
        )

    def windows(h: Column) -> Column:
        return F.transform(places, lambda i: F.xxhash64(*(h[i + k] for k in range(GRAM))))

    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    return F.when(F.size(w) < GRAM, 0).otherwise(let(hashed, by_hash))


def base_counts(text: Column) -> Column:
    """``struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words>`` of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    doubled = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def counts(w: Column) -> Column:
        named = {
            "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": symbols,
            "n_dup_lines": doubled, "n_repeat_words": repeated_words(w),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in named.items()))

    return let(words(text), counts)


def tokens(text: Column) -> Column:
    """Hashes of a text's words and runs of other characters, in lower case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return F.transform(parts, lambda t: F.xxhash64(t))


def bucket(*hashes: Column) -> Column:
    one = hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes)
    return F.pmod(one, F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class GramModel:
    """``ratios[b]``: log of how much likelier n-grams of bucket b are in trusted texts."""

    ratios: tuple[float, ...]

    def score(self, text: Column) -> Column:
        """Mean ratio over a text's unigrams and bigrams; 0 for a text without any."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")

        def mean(h: Column) -> Column:
            def add(t: Column) -> Column:
                pair = lambda i: t[bucket(h[i - 1], h[i])]
                return F.aggregate(
                    F.sequence(F.lit(0), F.size(h) - 1), F.lit(0.0),
                    lambda a, i: a + t[bucket(h[i])] + F.when(i > 0, pair(i)).otherwise(0.0),
                )

            return F.when(F.size(h) == 0, 0.0).otherwise(let(table, add) / (2 * F.size(h) - 1))

        return let(tokens(text), mean)


def fit(docs: DataFrame, trusted: DataFrame) -> GramModel:
    """From the whole of ``docs`` and those of them whose ``doc_id`` is in ``trusted`` (distinct
    ids). What reaches the driver has ``BUCKETS`` rows at most."""
    flags = trusted.select("doc_id", F.lit(1).alias("t"))
    rows = docs.select("doc_id", whole("text").alias("text")).join(flags, "doc_id", "left")
    grams = rows.select(
        F.coalesce("t", F.lit(0)).alias("t"),
        F.explode(
            let(
                tokens(F.col("text")),
                lambda h: F.concat(
                    F.transform(h, lambda x: bucket(x)),
                    F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: bucket(h[i], x)),
                ),
            )
        ).alias("b"),
    )
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not sum(good):
        return GramModel((0.0,) * BUCKETS)
    all_raw, all_good = sum(raw) + SMOOTHING * BUCKETS, sum(good) + SMOOTHING * BUCKETS
    ratio = lambda g, r: math.log((g + SMOOTHING) / all_good) - math.log((r + SMOOTHING) / all_raw)
    return GramModel(tuple(round(ratio(g, r), 6) for g, r in zip(good, raw)))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids labelled good and not toxic, ``rows`` at most; written, so that Spark sees the size."""
    ids = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "trusted")


def judged(docs: DataFrame, model: GramModel, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with a struct of counts, ``base_failed``, ``score`` and ``kept``, and its name."""
    text = whole("text")
    name = free_name(docs, "quality")

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        counts = [c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return let(
            model.score(text),
            lambda score: F.struct(
                *counts, failed.alias("base_failed"), score.alias("score"), (~failed & (score >= threshold)).alias("kept")
            ),
        )

    # One expression, so that a filter on the verdict does not compute it once per field it needs.
    return docs.withColumn(name, let(base_counts(text), verdict)), name


def report(docs: DataFrame, model: GramModel) -> DataFrame:
    """Per document row: ``doc_id``, the counts, ``base_failed``, ``kept`` and the ``score``."""
    rows, name = judged(docs.select("doc_id", "text"), model)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return rows.select("doc_id", *(F.col(f"{name}.{c}").alias(c) for c in columns))


def keep_good(docs: DataFrame, model: GramModel) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rows, name = judged(docs, model)
    return rows.filter(F.col(f"{name}.kept")).select(*docs.columns)
