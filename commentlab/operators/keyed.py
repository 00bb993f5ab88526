"""Per-key helpers that stay exact and spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import counted

# Up to this rank Spark trims each map task to the first n rows per key before the shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def salts_of(df: DataFrame) -> int:
    """Places for the rows of a hot key: as many as a shuffle has partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    The rank limit is applied before the shuffle too, so a hot key sends one row per task.
    """
    return top_per_key(df, keys, order, 1)


def one_per_key(df: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """At most one row per key: the first in the given order, or, without one, the only row.

    Without an order a key that occurs twice fails the job. Only a second row per key and task
    is kept for that test, so a hot key stays small.
    """
    if order:
        return first_per_key(df, [key], order)
    ranked = top_per_key(df, [key], [F.asc(key)], 2, "_rank")
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    return ranked.filter(F.when(F.col("_rank") == 1, True).otherwise(repeated.cast("boolean"))).drop("_rank")


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each key. The order should end with a unique column."""
    name = rank or "_rank"
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        # Past Spark's own limit, trim within salted parts of a key first.
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts_of(df)))
        by_part = W.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_in_part", F.row_number().over(by_part))
            .filter(F.col("_in_part") <= n)
            .drop("_part", "_in_part")
        )
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def salted_join(
    left: DataFrame, right: DataFrame, key: str, salts: int = 16, by: Sequence[str] = ()
) -> DataFrame:
    """Left join where one key may fill the left side; ``right`` has one row per key.

    The left rows of a key go to ``salts`` places, by the columns ``by`` or else all, and each
    right row is sent to all of them.
    """
    spread = F.pmod(F.xxhash64(*(by or left.columns)), F.lit(salts))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        left.withColumn("_salt", spread.cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")
    )


def lookup(table: DataFrame, key: str, value: Column) -> Column:
    """``value`` of the row of ``table`` with the current row's ``key``, else NULL.

    ``table`` has a row per class (of few). It becomes one map in a scalar subquery: evaluated
    once, when the query runs, and shipped as a constant, so the big side is not moved.
    """
    pairs = table.filter(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("k"), value.alias("v")).alias("p"))
    return F.element_at(pairs.agg(F.map_from_entries(F.collect_list("p")).alias("m")).scalar(), F.col(key))


def scalar_of(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery: evaluated once, shipped as a constant."""
    return df.agg(value.alias("v")).scalar()


def explode_rows(
    df: DataFrame, keep: Sequence[str | Column], array: str | Column, name: str, position: str | None = None
) -> DataFrame:
    """One row per array element, none for an empty array.

    A plain explode of a column makes the optimizer add a filter on the array's size, which
    then moves below the projection that computes the array and computes it twice. The outer
    form has no such filter; its row for an empty array is dropped by position.
    """
    place = position or "_pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(place, name)).filter(F.col(place).isNotNull())
    return out if position else out.drop(place)


def one_row_per_key(df: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """``keys`` and ``array``: rows of equal keys become one, their arrays joined end to end.

    One look at the keys tells whether there are any; without them no array is moved.
    """
    if df.groupBy(*keys).count().filter("count > 1").isEmpty():
        return df.select(*keys, array)
    none = F.array().cast(df.schema[array].dataType)
    return df.groupBy(*keys).agg(F.flatten(F.collect_list(F.coalesce(array, none))).alias(array))


def counted_rows(df: DataFrame, keys: Sequence[str], terms: str) -> DataFrame:
    """``keys, term, tf``: each distinct element of the array ``terms``, counted inside its row."""
    return run_rows(one_row_per_key(df, keys, terms), keys, terms)


def run_rows(df: DataFrame, keys: Sequence[str], terms: str) -> DataFrame:
    """The same for each row by itself: rows that share a key are not joined."""
    runs = df.select(*keys, counted(F.col(terms)).alias("_runs"))
    return explode_rows(runs, keys, "_runs", "_run").select(*keys, "_run.term", "_run.tf")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
