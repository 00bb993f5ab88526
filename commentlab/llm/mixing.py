"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target bytes over its share of the bytes
there are. Each document gets a Poisson count of that mean, by inverting the distribution at a
uniform number hashed from seed and document, and is exploded by the count; then all copies are
dealt out anew in the order of a hash.

Defined cases: a null source is a source of its own; null or empty texts weigh one byte, so that
every source has a size; rows alike in id and text get the same count; an empty table gives no
rows; other columns are carried along, whatever their names. A source without a weight, or with
weight 0, gets no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import explode_rows
from commentlab.session import materialize

from .common import free_name, let, packed, unpacked, whole

SEED = 42
# Target weight of a source: its bytes to this power. 1 keeps the mix, 0 makes sources equal.
TEMPERATURE = 0.7
# Larger means are the sum of parts of at most this mean, each with a uniform number of its own.
PART = 16.0
# Values with a smaller tail probability than 2**-53 are beyond a mean of PART.
VALUES = 80
# Places to which the rows of one source go where rates and rows meet in a shuffle.
SALTS = 16


def source_key(source: str) -> Column:
    """The source as text, with null apart from every text."""
    return F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def size_of(text: str) -> Column:
    return F.greatest(F.octet_length(whole(text)), F.lit(1)).cast("long")


def rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", epochs: float = 1.0) -> DataFrame:
    """``key, rate`` per source, from whole-table byte sums. ``weights`` has ``source, weight``."""
    sizes = docs.groupBy(source_key(source).alias("key")).agg(F.sum(size_of("text")).cast("double").alias("bytes"))
    if weights is None:
        given = sizes.withColumn("weight", F.pow("bytes", F.lit(TEMPERATURE)))
    else:
        named = weights.select(source_key("source").alias("key"), F.col("weight").cast("double").alias("weight"))
        given = sizes.join(named.groupBy("key").agg(F.max("weight").alias("weight")), "key")
    given = materialize(given, "source-sizes")
    totals = sizes.agg(F.sum("bytes")).scalar(), given.agg(F.sum("weight")).scalar()
    return given.select("key", (F.lit(epochs) * F.try_divide("weight", totals[1]) * totals[0] / F.col("bytes")).alias("rate"))


def cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... as an array."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("sums")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(VALUES)), start,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"), (a["sum"] + a["p"] * mean / k).alias("sum"),
            F.concat(a["sums"], F.array(a["sum"] + a["p"] * mean / k)).alias("sums"),
        ),
        lambda a: a["sums"],
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the digest of the seed and ``parts``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), *parts))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, source: str = "source", epochs: float = 1.0
) -> tuple[DataFrame, str]:
    """The copies, dealt out by hash, with a column that numbers a document's copies from 0.

    The second result is that column's name. Rates come by source, and one source may hold most
    rows, so the rows of a source are salted unless the rates are small enough to broadcast.
    """
    copy = free_name(docs, "copy")
    plan = rates(docs, weights, source, epochs).filter("rate > 0")
    n_parts = F.ceil(F.col("rate") / PART).cast("int")
    plan = plan.select("key", n_parts.alias("parts"), cumulative(F.col("rate") / n_parts).alias("sums"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    plan = materialize(plan.withColumn("salt", F.explode(salts)), "rates")
    ident = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), whole("row.text")
    salt = F.pmod(F.xxhash64(*ident), F.lit(SALTS)).cast("int")
    rows = packed(docs).withColumns({"key": source_key(f"row.`{source}`"), "salt": salt})

    def draw(part: Column) -> Column:
        # The number is drawn once, not once for each probability it is compared with.
        return let(uniform(part.cast("string"), *ident), lambda u: F.size(F.filter("sums", lambda c: c <= u)))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, part: a + draw(part))
    copies = explode_rows(rows.join(plan, ["key", "salt"]), ["row"], F.array_repeat(F.lit(True), drawn), "one", copy)
    dealt = copies.withColumn("place", F.xxhash64(F.lit(SEED), copy, *ident))
    return unpacked(dealt.repartition("place").sortWithinPartitions("place"), copy), copy


def report(docs: DataFrame) -> DataFrame:
    """The mixed rows with the columns of ``documents`` and the number of the ``copy``."""
    return mix(docs)[0]


ORACLE_SQL = f"""WITH RECURSIVE sized AS (
  SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key,
         greatest(strlen(coalesce(text, '')), 1) AS bytes
  FROM documents),
sizes AS (SELECT key, CAST(sum(bytes) AS DOUBLE) AS bytes FROM sized GROUP BY key),
rates AS (
  SELECT key, pow(bytes, {TEMPERATURE}) / (SELECT sum(pow(bytes, {TEMPERATURE})) FROM sizes)
         * (SELECT sum(bytes) FROM sizes) / bytes AS rate
  FROM sizes),
parts AS (SELECT key, CAST(ceil(rate / {PART}) AS INTEGER) AS parts, rate / ceil(rate / {PART}) AS mean FROM rates),
steps AS (
  SELECT key, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS total FROM parts
  UNION ALL
  SELECT key, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps WHERE k < {VALUES}),
draws AS (
  SELECT d.doc_id, d.text, d.key, p.part,
         CAST(CAST('0x' || left(md5(concat_ws('|', '{SEED}', p.part, d.doc_id, d.text)), 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496 AS u
  FROM (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, coalesce(text, '') AS text, key FROM sized) d
  JOIN (SELECT key, unnest(range(1, parts + 1)) AS part FROM parts) p ON d.key = p.key),
counts AS (
  SELECT doc_id, text, draws.key, count(steps.key) AS n
  FROM draws LEFT JOIN steps ON draws.key = steps.key AND steps.total <= draws.u GROUP BY ALL)
SELECT s.doc_id, s.text, s.lang, s.source, s.n_chars, CAST(unnest(range(0, c.n)) AS INTEGER) AS copy
FROM sized s JOIN counts c
  ON coalesce(CAST(s.doc_id AS VARCHAR), '') = c.doc_id AND coalesce(s.text, '') = c.text AND s.key = c.key"""
