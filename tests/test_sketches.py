import pytest
from pyspark.sql import functions as F

from commentlab.operators import sketches as sk
from commentlab.plans import ENTRIES
from commentlab.session import new_path


def rows_of(spark, start, end):
    part = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")
    return spark.range(start, end).select(part.alias("part"), (F.col("id") % 1000).alias("size"), (F.col("id") % 700).alias("word"))


def stored(spark, *frames):
    target = new_path(spark, "sketches")
    for df in frames:
        made = sk.part_sketches(df, "part", ["size"], ["word"])
        sk.store_parts(made, "part", target)
    return sk.stored_parts(spark, target, "part", made.schema)


def figures(df):
    return df.select("n", sk.quantile("size", 0.5).alias("median"), sk.distinct("word").alias("words"))


def test_parts_are_merged(spark):
    got = figures(sk.merged(stored(spark, rows_of(spark, 0, 30_000)))).first()
    assert got["n"] == 30_000
    assert got["median"] == pytest.approx(500, abs=10)
    assert got["words"] == pytest.approx(700, rel=0.05)


def test_new_parts_join_old_ones_and_a_repeated_part_counts_once(spark):
    rows = rows_of(spark, 0, 9_000)
    parts = stored(spark, rows.filter("part = 'a'"), rows.filter("part = 'b' OR part IS NULL"), rows.filter("part = 'a'"))
    got = {r["part"]: r["n"] for r in parts.select("part", "n").collect()}
    assert got == {"a": 3_000, "b": 3_000, None: 3_000}
    assert figures(sk.merged(parts)).first()["words"] == pytest.approx(700, rel=0.05)


def test_merged_by_part_keeps_them_apart(spark):
    got = sk.merged(stored(spark, rows_of(spark, 0, 9_000)), ["part"]).select("part", sk.distinct("word").alias("d"))
    assert {r["part"]: r["d"] for r in got.collect()} == pytest.approx({"a": 700, "b": 700, None: 700}, rel=0.05)


def test_nulls_blank_parts_and_empty_tables(spark):
    schema = "part string, size int, word string"
    odd = spark.createDataFrame([("", None, None), (None, None, None)], schema)
    got = figures(sk.merged(stored(spark, odd))).first()
    assert (got["n"], got["median"], got["words"]) == (2, None, 0)
    assert stored(spark, odd).count() == 1
    empty = sk.part_sketches(odd.limit(0), "part", ["size"], ["word"])
    assert empty.count() == 0
    got = figures(sk.merged(empty)).first()
    assert (got["n"], got["median"], got["words"]) == (0, None, 0)


def test_rank_bounds_are_exact(spark):
    rows = spark.createDataFrame([("x", v) for v in (1, 2, 2, 3, None)], "name string, v int")
    estimates = spark.createDataFrame([("x", 0.5, 2)], "name string, q double, estimate int")
    got = sk.rank_bounds(rows, "name", "v", estimates).first()
    assert (got["below"], got["upto"]) == (0.25, 0.75)


@pytest.mark.parametrize("name", ["sketched_lengths", "sketched_vocabulary"])
def test_sketched_figures_are_close(spark, sf, name):
    rows = ENTRIES[name].run(spark, sf).collect()
    assert rows and all(r["close"] for r in rows)
