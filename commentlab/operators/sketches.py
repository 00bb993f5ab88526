"""Mergeable sketches of a growing corpus: one row per part, stored, merged when read.

A part (a language, a day, a load) is read once, when it arrives. Medians, quantiles and distinct
counts of any union of parts then come from the stored sketches, whose size does not depend on the
number of rows. Storing a part again replaces it, so a repeated load counts once.

Defined cases: null values are not counted; a blank part name is a null part, which is stored like
any other; an empty table stores nothing; a quantile of no values is null and their distinct count 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Sizes of the sketches: rank errors of about 0.4 %, relative errors of distinct counts of about 0.8 %.
QUANTILE_K = 800
DISTINCT_LG_K = 14

QUANTILES, DISTINCT = "_quantiles", "_distinct"  # endings of the stored columns


def part_sketches(df: DataFrame, part: str, numbers: Sequence[str] = (), items: Sequence[str] = ()) -> DataFrame:
    """``part, n`` and a sketch per column: quantiles of whole ``numbers``, distinct values of ``items``.

    Sketches are filled map-side, so a part of any size is a small row before the shuffle.
    """
    name = F.nullif(F.col(part).cast("string"), F.lit("")).alias(part)
    kept = df.select(name, *dict.fromkeys([*numbers, *items]))
    return kept.groupBy(part).agg(
        F.count("*").alias("n"),
        *(F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), QUANTILE_K).alias(c + QUANTILES) for c in numbers),
        *(F.hll_sketch_agg(F.col(c).cast("string"), DISTINCT_LG_K).alias(c + DISTINCT) for c in items),
    )


def store_parts(sketches: DataFrame, part: str, target: str) -> None:
    """Write each part to its own folder below ``target``; other parts stay as they are."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(part).parquet(target)


def stored_parts(spark: SparkSession, target: str, part: str, schema: StructType) -> DataFrame:
    """All stored parts. The schema is that of ``part_sketches``, as folder names carry no types."""
    fields = sorted(schema.fields, key=lambda f: f.name == part)
    return spark.read.schema(StructType(fields)).parquet(target)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n`` and the sketches of all parts together; without ``by`` one row."""
    each = [F.kll_merge_agg_bigint(c, QUANTILE_K).alias(c) for c in sketches.columns if c.endswith(QUANTILES)]
    each += [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.endswith(DISTINCT)]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), *each)


def quantile(number: str, q: float) -> Column:
    sketch = F.col(number + QUANTILES)
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(q)))


def distinct(item: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(item + DISTINCT), F.lit(0).cast("bigint"))


def rank_bounds(rows: DataFrame, name: str, value: str, estimates: DataFrame) -> DataFrame:
    """``name, q, below, upto``: the exact shares of values less than, and not above, each estimate.

    ``estimates`` (``name, q, estimate``) is a row per figure; values are counted before they meet it.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(name, value).agg(F.count("*").alias("_n"))
    met = counts.join(estimates, name)
    total = F.sum("_n")
    return met.groupBy(name, "q").agg(
        (F.sum(F.when(F.col(value) < F.col("estimate"), F.col("_n")).otherwise(0)) / total).alias("below"),
        (F.sum(F.when(F.col(value) <= F.col("estimate"), F.col("_n")).otherwise(0)) / total).alias("upto"),
    )
