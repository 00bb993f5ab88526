"""Table changes as new versions: the old rows and the new ones give the next table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_per_key, one_per_key, union_all


def replace_rows(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """New rows replace old ones of the same key whole; fields they lack are gone.

    Of several new rows with one key the first in ``order`` counts; without an order a repeated
    key fails the job.
    """
    new = one_per_key(new, key, order)
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def set_fields(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Named fields of matching rows change, also to NULL; unknown keys are added.

    Repeated keys among the new rows as in ``replace_rows``.
    """
    new = one_per_key(new, key, order)
    fields = [c for c in new.columns if c != key]
    staged = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = old.join(staged, key, "full_outer")
    known = set(old.columns)
    for c in fields:
        before = F.col(c) if c in known else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(before))
    return out.drop("_hit", *[f"_new_{c}" for c in fields])


def match_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many update rows have a target row and how many have none."""
    marked = new.select(key).join(old.select(key, F.lit(True).alias("_hit")), key, "left")
    return marked.agg(
        F.count("*").alias("n_labels"),
        F.count_if(F.col("_hit").isNotNull()).alias("n_matched"),
        F.count_if(F.col("_hit").isNull()).alias("n_unmatched"),
    )


def insert_new(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows to append: the first of each key not yet in the table."""
    return first_per_key(new, [key], order).join(old.select(key), key, "left_anti")


def insert_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many of the new rows are inserted and how many skipped as known or repeated."""
    per_key = new.groupBy(key).agg(F.count("*").alias("_rows"))
    marked = per_key.join(old.select(key, F.lit(True).alias("_known")), key, "left")
    given, inserted = F.coalesce(F.sum("_rows"), F.lit(0)), F.count_if(F.col("_known").isNull())
    return marked.agg(given.alias("n_given"), inserted.alias("n_inserted"), (given - inserted).alias("n_skipped"))


def missing_rows(source: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Source rows the derived table does not have yet."""
    return source.join(derived.select(key), key, "left_anti")


def all_found(source: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """The rows of ``derived`` for the keys of ``source``; a key without a row fails the job."""
    found = source.select(key).distinct().join(derived.withColumn("_found", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    return found.filter(F.when(F.col("_found"), True).otherwise(lost.cast("boolean"))).drop("_found")


def set_membership(members: DataFrame, subset: str, ids: DataFrame, key: str) -> DataFrame:
    """The (subset, id) table with one subset's members replaced."""
    listed = ids.select(F.lit(subset).alias("subset"), key).distinct()
    return members.filter(F.col("subset") != subset).select("subset", key).unionByName(listed)


def membership_report(members: DataFrame, subset: str, ids: DataFrame, key: str) -> DataFrame:
    """How many members a replaced subset loses, has set, and keeps among those."""
    old = members.filter(F.col("subset") == subset).select(key).distinct().withColumn("_old", F.lit(True))
    both = old.join(ids.select(key).distinct().withColumn("_new", F.lit(True)), key, "full_outer")
    was, now = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return both.agg(
        F.count_if(was & ~now).alias("n_cleared"), F.count_if(now).alias("n_set"), F.count_if(was & now).alias("n_kept")
    )


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def delete_report(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> DataFrame:
    """Rows per table that the deletion takes and leaves."""
    listed = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return union_all(
        [
            df.select(key).join(listed, key, "left").agg(
                F.lit(name).alias("table_name"),
                F.count_if(F.col("_gone").isNotNull()).alias("n_deleted"),
                F.count_if(F.col("_gone").isNull()).alias("n_left"),
            )
            for name, df in tables.items()
        ]
    )


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys only in the old set ('out') and only in the new one ('in'), in one join."""
    a = old.select(key).distinct().withColumn("_a", F.lit(1))
    b = new.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "out").when(F.col("_a").isNull(), "in")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).filter("side IS NOT NULL")


def difference_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many keys come in and how many go out."""
    changes = set_difference(old, new, key)
    return changes.agg(F.count_if(F.col("side") == "in").alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"))
