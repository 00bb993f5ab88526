"""Exact ranks, samples, folds and quantiles without sorting a class in one task.

A row's place is decided by a seeded hash of its id. Counting rows per hash prefix shows in
which prefix the n-th row lies; only that prefix is ranked. The result is one cut-off key
per class, and assigning rows is then a comparison in the scan, with no shuffle of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keyed import lookup, top_per_key

PREFIX = 4  # hex digits, so 65,536 parts per class


def seeded_hash(key: str | Column, seed: int = 42) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def allot(totals: DataFrame, group: str, size: str, amount: Column, out: str) -> DataFrame:
    """Share ``amount`` over the classes in proportion to ``size``, by largest remainder.

    ``totals`` is one row per class. Ties go to the smaller class.
    """
    whole = W.partitionBy()
    n = F.col("_n")
    df = (
        totals.withColumn("_n", F.col(size).cast("decimal(18,0)"))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_amount", amount.cast("decimal(18,0)"))
        .withColumn("_base", F.expr("(_amount * _n) div _all"))
        .withColumn("_rest", F.expr("(_amount * _n) % _all"))
    )
    left = F.col("_amount") - F.sum("_base").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc("_rest"), group))
    extra = F.when((place <= left) & (n > 0), 1).otherwise(0)
    return df.withColumn(out, (F.col("_base") + extra).cast("bigint")).drop(
        "_n", "_all", "_amount", "_base", "_rest"
    )


def hash_cutoffs(
    df: DataFrame, group: str, key: str, cuts: DataFrame, seed: int = 42, prefix: int = PREFIX
) -> DataFrame:
    """For each (group, _cut, _rank) of ``cuts``, the hash and key of the row at that rank.

    ``cuts`` holds a few ranks for each class. A rank of 0 gives no row. Only narrow columns
    are read: once to count the prefixes, once to rank the rows of the prefixes in question.
    """
    keyed = df.select(group, key, seeded_hash(key, seed).alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, prefix)
    )
    counts = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_cnt"))
    upto = F.sum("_cnt").over(W.partitionBy(group).orderBy("_bucket"))
    spans = counts.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_cnt"))
    located = (
        spans.join(cuts, group)
        .filter((F.col("_rank") > F.col("_lo")) & (F.col("_rank") <= F.col("_hi")))
        .select(group, "_bucket", "_cut", (F.col("_rank") - F.col("_lo")).alias("_need"))
    )
    # The few prefixes in question, by class; the rows of others go no further than the scan.
    cells = located.groupBy(group).agg(F.collect_list(F.struct("_bucket", "_cut", "_need")).alias("_cells"))
    marked = keyed.withColumn("_cells", lookup(cells, group, F.col("_cells")))
    here = F.filter("_cells", lambda c: c["_bucket"] == F.col("_bucket"))
    inside = marked.select(group, key, "_h", F.explode(here).alias("_c")).select(group, key, "_h", "_c._cut", "_c._need")
    place = F.row_number().over(W.partitionBy(group, "_cut").orderBy("_h", key))
    return (
        inside.withColumn("_place", place)
        .filter(F.col("_place") == F.col("_need"))
        .select(group, "_cut", F.col("_h").alias("_cut_hash"), F.col(key).alias("_cut_key"))
    )


def assign_by_cutoffs(
    df: DataFrame,
    group: str,
    key: str,
    cutoffs: DataFrame,
    names: Sequence[str],
    rest: str | int,
    out: str,
    seed: int = 42,
) -> DataFrame:
    """Label each row with the first cut it does not exceed, else ``rest``.

    With up to thousands of classes this is a comparison in the scan, with no shuffle.
    """
    wide = cutoffs.groupBy(group).agg(
        *[
            F.max(F.when(F.col("_cut") == F.lit(n), F.struct("_cut_hash", "_cut_key"))).alias(f"_c{i}")
            for i, n in enumerate(names)
        ]
    )
    here = F.struct(F.col("_h").alias("_cut_hash"), F.col(key).alias("_cut_key"))
    value = F.lit(rest)
    for i, n in reversed(list(enumerate(names))):
        value = F.when(F.coalesce(here <= F.col(f"_cuts._c{i}"), F.lit(False)), F.lit(n)).otherwise(value)
    return (
        df.withColumn("_h", seeded_hash(key, seed))
        .withColumn("_cuts", lookup(wide, group, F.struct(*[f"_c{i}" for i in range(len(names))])))
        .withColumn(out, value)
        .drop("_h", "_cuts")
    )


def split_quotas(df: DataFrame, group: str) -> DataFrame:
    """Rows per class for test (a tenth), val (two ninths of the rest) and train."""
    totals = df.groupBy(group).agg(F.count("*").alias("n_all"))
    whole = W.partitionBy()
    n = F.sum("n_all").over(whole)
    test = allot(totals.withColumn("_t", F.expr("0")), group, "n_all", F.ceil(n / 10), "n_test")
    left = test.drop("_t").withColumn("n_left", F.col("n_all") - F.col("n_test"))
    # ceil(2 * left / 9) in whole numbers
    val_amount = F.floor((F.sum("n_left").over(whole) * 2 + 8) / 9)
    val = allot(left, group, "n_left", val_amount, "n_val")
    return val.withColumn("n_train", F.col("n_left") - F.col("n_val")).drop("n_left")


def stratified_split(
    df: DataFrame, key: str, group: str, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Deterministic train / val / test of exact sizes, in proportion within each class."""
    quotas = split_quotas(df.select(group), group)
    upto = F.col("n_test") + F.col("n_val")
    ranks = F.array(
        F.struct(F.lit("test").alias("_cut"), F.col("n_test").alias("_rank")),
        F.struct(F.lit("val").alias("_cut"), upto.alias("_rank")),
    )
    cuts = quotas.select(group, F.inline(ranks))
    found = hash_cutoffs(df.select(group, key), group, key, cuts, seed)
    return assign_by_cutoffs(df, group, key, found, ["test", "val"], "train", out, seed)


def stratified_kfold(
    df: DataFrame, key: str, group: str, k: int = 5, seed: int = 42, out: str = "kfold"
) -> DataFrame:
    """``k`` folds whose sizes differ by at most one row per class."""
    totals = df.groupBy(group).agg(F.count("*").alias("_n"))
    step = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("_i")
    cuts = totals.select(group, "_n", step).select(
        group, (F.col("_i") - 1).alias("_cut"), F.expr(f"(_n * _i) div {k}").alias("_rank")
    )
    found = hash_cutoffs(df.select(group, key), group, key, cuts, seed)
    return assign_by_cutoffs(df, group, key, found, list(range(k - 1)), k - 1, out, seed)


def sample_exact(
    df: DataFrame,
    key: str,
    n: int | Mapping[object, int],
    group: str | None = None,
    seed: int = 42,
    require: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows (per class, if a class is given), drawn by seeded hash.

    A class with fewer rows gives all of them; with ``require`` that is an error instead.
    """
    single = group is None
    if single:
        group = "_one"
        df = df.withColumn(group, F.lit(1))
    totals = df.groupBy(group).agg(F.count("*").alias("_n"))
    if isinstance(n, Mapping):
        pairs = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])
        want = F.coalesce(F.element_at(pairs, F.col(group)), F.lit(0))
    else:
        want = F.lit(n)
    rank = F.least(want.cast("bigint"), F.col("_n"))
    if require:
        rank = F.when(F.col("_n") >= want, want.cast("bigint")).otherwise(
            F.raise_error(F.lit("sample is larger than the pool")).cast("bigint")
        )
    cuts = totals.select(group, F.lit("in").alias("_cut"), rank.alias("_rank"))
    found = hash_cutoffs(df.select(group, key), group, key, cuts, seed)
    picked = assign_by_cutoffs(df, group, key, found, ["in"], "out", "_pick", seed)
    picked = picked.filter(F.col("_pick") == "in").drop("_pick")
    return picked.drop(group) if single else picked


def exact_rank(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "rank",
) -> DataFrame:
    """Position of each row in its group, 1-based, with the work spread over the buckets.

    ``bucket`` must not decrease along ``order``. Rows before a bucket are counted on the
    small (group, bucket) table; both sides of the join share the window's partitioning.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_cnt"))
    upto = F.sum("_cnt").over(W.partitionBy(*groups).orderBy("_bucket"))
    offsets = counts.select(*groups, "_bucket", (upto - F.col("_cnt")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, [*groups, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def with_quantile_bucket(df: DataFrame, position: str, out: str = "_quantile") -> DataFrame:
    """Adds buckets of nearly equal size over a numeric column, a few for each shuffle partition.

    The bounds are approximate quantiles, so clustered values do not share one bucket; any
    bounds give exact ranks. They come as one scalar subquery, and each row finds its bucket
    by binary search, one column per step.
    """
    steps = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length() + 2
    n = 1 << steps
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.percentile_approx(position, shares, 10 * n).alias("b")).scalar()
    df = df.withColumn(out, F.lit(0))
    for step in (1 << i for i in reversed(range(steps))):
        above = F.get(bounds, F.col(out) + (step - 1)) < F.col(position)
        df = df.withColumn(out, F.col(out) + F.when(above, step).otherwise(0))
    return df


def shuffled_rank(
    df: DataFrame, key: str, groups: Sequence[str] = (), seed: int = 42, out: str = "rank"
) -> DataFrame:
    """Position of each row in a seeded shuffle, over all rows or within each group."""
    hashed = df.withColumn("_h", seeded_hash(key, seed))
    bucket = F.substring("_h", 1, PREFIX)
    return exact_rank(hashed, groups, bucket, [F.col("_h"), F.col(key)], out).drop("_h")


def round_robin(df: DataFrame, key: str, group: str, seed: int = 42) -> DataFrame:
    """An order whose every prefix holds the classes as evenly as can be: turn, then class."""
    return shuffled_rank(df, key, [group], seed, "turn")


def top_by_score(
    df: DataFrame, group: str, n: int, key: str, score: str, first: Sequence[Column] = ()
) -> DataFrame:
    """The ``n`` best-scored rows of each class, optional sort keys before the score."""
    return top_per_key(df, [group], [*first, F.desc(score), F.asc(key)], n)


def exact_median(
    df: DataFrame, group: str, value: str, lo: float, hi: float, out: str, buckets: int = 4096
) -> DataFrame:
    """Exact median per class of a number known to lie between ``lo`` and ``hi``.

    Counts per bucket show where the middle ranks lie; only the distinct values of those
    buckets are then counted, so a value shared by many rows is a single row by then.
    """
    width = (hi - lo) / buckets
    place = F.least(F.floor((F.col(value) - lo) / width), F.lit(buckets - 1))
    base = df.filter(F.col(value).isNotNull()).select(
        group, F.col(value).cast("double").alias("_v"), place.alias("_b")
    )
    by_bucket = base.groupBy(group, "_b").agg(F.count("*").alias("_cnt"))
    whole = W.partitionBy(group)
    spans = by_bucket.select(
        group,
        "_b",
        (F.sum("_cnt").over(whole.orderBy("_b")) - F.col("_cnt")).alias("_lo"),
        F.sum("_cnt").over(whole.orderBy("_b")).alias("_hi"),
        F.sum("_cnt").over(whole).alias("_n"),
    )
    r1, r2 = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    holds = (r1.between(F.col("_lo") + 1, F.col("_hi"))) | (r2.between(F.col("_lo") + 1, F.col("_hi")))
    middle = spans.filter(holds)
    cells = middle.groupBy(group).agg(F.collect_list(F.struct("_b", "_lo", "_n")).alias("_cells"))
    marked = base.withColumn("_cells", lookup(cells, group, F.col("_cells")))
    here = F.filter("_cells", lambda c: c["_b"] == F.col("_b"))
    values = (
        marked.select(group, "_b", "_v", F.explode(here).alias("_c"))
        .select(group, "_b", "_v", "_c._lo", "_c._n")
        .groupBy(group, "_b", "_v", "_lo", "_n")
        .agg(F.count("*").alias("_c"))
    )
    inside = W.partitionBy(group, "_b").orderBy("_v")
    upto = F.col("_lo") + F.sum("_c").over(inside)
    ranked = values.withColumn("_to", upto).withColumn("_from", upto - F.col("_c") + 1)
    ends = [
        F.max(F.when(r.between(F.col("_from"), F.col("_to")), F.col("_v"))) for r in (r1, r2)
    ]
    return ranked.groupBy(group).agg(((ends[0] + ends[1]) / 2).alias(out))

