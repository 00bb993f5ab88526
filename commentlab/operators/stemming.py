"""Stemming through a table of (token, stem): its cost follows the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import PROTECTED_ROOTS
from .keyed import explode_rows, salted_join


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    return explode_rows(df, [], tokens, "token").distinct()


def stem_table_from(
    words: DataFrame, make_stemmer: Callable[[], Callable[[str], str]]
) -> DataFrame:
    """(token, stem) from a per-word function, which runs once per distinct word.

    ``make_stemmer`` is called once per task, so that loading a dictionary is not repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem = make_stemmer()
        for batch in batches:
            yield pd.DataFrame({"token": batch["token"], "stem": batch["token"].map(stem)})

    return words.select("token").mapInPandas(run, "token string, stem string")


def _effective(stems: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Stem rows that change a word and may do so; one row per token."""
    kept = stems.filter((F.col("token") != F.col("stem")) & ~F.col("token").isin(list(protected)))
    return kept.groupBy("token").agg(F.min("stem").alias("stem"))


def distinct_stems(
    df: DataFrame, tokens: str, stems: DataFrame, protected: Sequence[str] = PROTECTED_ROOTS
) -> DataFrame:
    words = vocabulary(df, tokens)
    return words.join(_effective(stems, protected), "token", "left").select(
        "token", F.coalesce("stem", "token").alias("stem")
    )


def stem_tokens(
    df: DataFrame,
    key: str,
    tokens: str,
    stems: DataFrame,
    protected: Sequence[str] = PROTECTED_ROOTS,
) -> DataFrame:
    """``df`` with each word of the array replaced by its stem, in the same order.

    ``key`` is unique. The texts are spread by it before they are exploded, so that where Spark
    broadcasts the stem table the words need no shuffle to come together again. Where it does
    not, they are joined with a salt, because a few words make up a large part of any text. All
    other columns travel with the first word of a row, so ``df`` is read once.
    """
    table = _effective(stems, protected)
    rest = [c for c in df.columns if c not in (key, tokens)]
    spread = df.repartition(F.col(key)).withColumn("_rest", F.struct(F.lit(1).alias("_one"), *rest))
    # A text without words still has a row, with a NULL place.
    words = spread.select(key, "_rest", F.posexplode_outer(tokens).alias("_pos", "token")).withColumn(
        "_rest", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_rest"))
    )
    joined = salted_join(words, table, "token", by=[key, "_pos"])
    pair = F.when(F.col("token").isNotNull(), F.struct("_pos", F.coalesce("stem", "token").alias("word")))
    rebuilt = joined.groupBy(key).agg(
        F.first("_rest", ignorenulls=True).alias("_rest"), F.array_sort(F.collect_list(pair)).alias("_words")
    )
    out = rebuilt.select(key, "_rest.*", F.transform("_words", lambda x: x["word"]).alias(tokens))
    return out.select(*df.columns)
