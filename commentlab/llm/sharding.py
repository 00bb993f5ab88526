"""Sharding by extendible hashing: shards of at most so many bytes, addressed by hash prefix.

Every document has 60 hash bits. All start in one bucket; a bucket over the byte limit is split
by its next bit, and only such a bucket. The directory maps hash prefixes to buckets. It is made
from byte sums per prefix, a few for each shard, not from rows.

Defined cases: a document over the limit has a shard of its own; rows alike in id and text have
the same hash, no bit parts them, so where they exceed the limit their bucket is cut into pages
(``-0``, ``-1``, ...); a null text has no bytes; an empty table gives no rows; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentlab.session import materialize

from .common import free_name, packed, unpacked, whole

LIMIT = 32 << 20
BITS = 60
# Bits counted beyond those that an even hash needs. Buckets still over the limit go on.
SPARE = 4


def addressed(docs: DataFrame) -> DataFrame:
    """``row``, its hash bits ``key`` and its ``size`` in bytes."""
    text = whole("row.text")
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), text))
    key = F.conv(F.left(digest, F.lit(BITS // 4)), 16, 10).cast("long")
    return packed(docs).select("row", key.alias("key"), F.octet_length(text).cast("long").alias("size"))


def prefix(of: Column, depth: Column | int, bits: int = BITS) -> Column:
    """The first ``depth`` of ``bits`` bits."""
    return F.call_function("shiftright", of, (F.lit(bits) - depth).cast("int"))


def split_buckets(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Leads each cell, a prefix of ``high`` bits, to its bucket: ``cell, depth``.

    ``depth`` is the least above ``low`` at which the cell's prefix fits the limit or holds a
    single row, null if there is none.
    """
    levels = cells.select(
        "cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    ).withColumn("prefix", prefix(F.col("cell"), F.col("depth"), high))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = sums.filter((F.col("bytes") <= limit) | (F.col("n") == 1)).select("depth", "prefix")
    reached = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(reached, "cell", "left")


def cells_of(rows: DataFrame, bits: int) -> DataFrame:
    return rows.groupBy(prefix(F.col("key"), bits).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def assign(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, str]:
    """``docs`` with a struct of ``shard``, its ``depth`` and the row's ``n_bytes``, and its name."""
    at = free_name(docs, "shard")
    rows = addressed(docs)
    keys = addressed(docs.select("doc_id", "text")).select("key", "size")
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    high = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SPARE)
    first = materialize(split_buckets(cells_of(keys, high), 0, high, limit), "directory")
    rows = rows.join(first, prefix(F.col("key"), high) == F.col("cell")).drop("cell").withColumn("page", F.lit(None).cast("long"))
    if high < BITS and not first.filter("depth IS NULL").isEmpty():
        # Buckets that an even hash would have split by now: go on by whole hashes.
        over = first.filter("depth IS NULL").select("cell")
        deep = keys.join(over, prefix(F.col("key"), high) == F.col("cell"), "left_semi")
        second = materialize(split_buckets(cells_of(deep, BITS), high + 1, BITS, limit), "directory")
        second = second.select(F.col("cell").alias("key"), F.col("depth").alias("deeper"))
        rows = rows.join(second, "key", "left").withColumn("depth", F.coalesce("depth", "deeper")).drop("deeper")
        if not second.filter("deeper IS NULL").isEmpty():
            rows = paged(rows, limit)
    depth = F.coalesce("depth", F.lit(BITS))
    bits = F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix(F.col("key"), depth)), depth, F.lit("0")))
    page = F.coalesce(F.concat(F.lit("-"), F.col("page").cast("string")), F.lit(""))
    named = F.struct(F.concat(F.lit("s"), bits, page).alias("shard"), depth.cast("int").alias("depth"), F.col("size").alias("n_bytes"))
    return unpacked(rows.withColumn(at, named), at), at


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """Numbers rows whose whole hash is alike and puts as many on a ``page`` as the limit allows.

    Rows are numbered per input partition; counts of the partitions give each its first number.
    So a hash that a third of all rows share is not numbered in one task.
    """
    rows = materialize(rows.withColumn("part", F.when(F.col("depth").isNull(), F.spark_partition_id())), "stuck-rows")
    stuck, free = rows.filter("part IS NOT NULL"), rows.filter("part IS NULL")
    counts = stuck.groupBy("key", "part").agg(F.count("*").alias("in_part"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("key", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(W.partitionBy("key", "part").orderBy("size"))
    numbered = stuck.withColumn("place", place).join(starts, ["key", "part"])
    # Rows of one hash are alike, so they have one size; a page has at least one of them.
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("size"), F.lit(1))))
    page = F.floor((F.col("first") + F.col("place") - 1) / per_page).cast("long")
    return numbered.withColumn("page", page).drop("place", "first").unionByName(free)


def report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document row: ``doc_id, shard, depth, n_bytes``."""
    rows, at = assign(docs.select("doc_id", "text"), limit)
    return rows.select("doc_id", f"{at}.shard", f"{at}.depth", f"{at}.n_bytes")


def gathered(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns and ``shard`` (or the next free name), the rows of a shard together."""
    rows, at = assign(docs, limit)
    return rows.withColumn(at, F.col(f"{at}.shard")).repartition(at)


ORACLE_SQL = f"""WITH hashed AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         CAST('0x' || left(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), {BITS // 4}) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT h, n_bytes, unnest(range(0, {BITS + 1})) AS depth FROM hashed),
sums AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix FROM levels GROUP BY 1, 2
  HAVING sum(n_bytes) <= {LIMIT} OR count(*) = 1),
least_depth AS (
  SELECT hashed.h, min(sums.depth) AS depth FROM hashed
  JOIN sums ON hashed.h >> ({BITS} - sums.depth) = sums.prefix GROUP BY hashed.h)
SELECT doc_id, CAST('s' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), CAST(depth AS INTEGER), '0') END AS VARCHAR) AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes
FROM hashed JOIN least_depth USING (h)"""
