"""Phrase collocations from one count of the longest windows.

Each word gives one window: itself and its lead columns, the next ``size - 1`` words of its piece,
null past the end. Only these windows are counted, first within a task (numpy over numbered words),
then over all; no text is exploded into n-grams of each length. Windows are dealt out by their first
words, so sums over the last ones need no shuffle; a pair that is too rare to be a phrase, or a part of
one, ends after its first word, and ``ROLLUP`` sums what is left to all shorter prefixes, down to
the number of words.

Everything is per language. Windows are combined before the shuffle, so a hot pair of words is a row
per task and window; counts of the few words that many phrases share are broadcast.

Defined cases: a null text is empty and gives nothing, a null language is ``und``; ids are not used,
so repeated rows count as often as they occur; a language without phrases has no rows; ties end
with the phrase itself, which is unique; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import scalar_of, top_per_key, union_all
from commentlab.session import materialize

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SIZE = 3  # words of the longest phrases
LEAST = 10  # occurrences of a candidate
TOP = 2000  # rows of a language
HOT = 1000  # words that may be broadcast
SCALE = 1_000_000  # of a score
# A longer candidate hides a phrase if it holds this share of its occurrences.
HIDES, OF = 50, 100

# Characters of texts cut up at a time, and windows that a task combines before it hands them on.
TOGETHER, HELD = 1 << 22, 1 << 22
PLACES = 1 << 16  # of first words; more than a shuffle has partitions

# What ends a piece, and what parts its words.
ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


def keyed(phrase: Column) -> Column:
    """Phrase and language as one text; no phrase holds a tab."""
    return F.concat(phrase, F.lit("\t"), "lang")


def phrase_of_key() -> Column:
    return F.substring_index("key", "\t", 1)


def lang_of_key() -> Column:
    return F.expr("substring(key, instr(key, '\t') + 1)")


class Windows:
    """Counts of windows of numbered words, by language."""

    def __init__(self, size: int) -> None:
        self.size, self.bits = size, 63 // size
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}  # from 1 on; 0 stands past the end of a piece
        self.counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = self.merged = 0

    def add(self, langs: list[str], texts: pa.Array) -> None:
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), ENDS)
        parts = pc.split_pattern_regex(pieces.flatten(), BLANKS)
        words = parts.flatten()
        names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        lengths = lambda x: x.value_lengths().to_numpy(zero_copy_only=False)
        lang = np.repeat(np.array([names[x] for x in langs], np.int64), lengths(pieces))
        kept = np.nonzero(pc.binary_length(words).to_numpy(zero_copy_only=False))[0]
        piece = np.repeat(np.arange(len(parts)), lengths(parts))[kept]
        lang, coded = lang[piece], words.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        number = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in listed], np.int64)
        code = number[coded.indices.to_numpy(zero_copy_only=False)[kept]]
        window = code.copy()
        for k in range(1, self.size):
            lead = np.zeros_like(code)
            lead[:-k] = np.where(piece[k:] == piece[:-k], code[k:], 0)
            window = (window << self.bits) | lead
        for name, k in names.items():
            found = np.unique(window[lang == k], return_counts=True)
            self.counts.setdefault(name, []).append(found)
            self.held += len(found[0])
        if self.held > 2 * self.merged + HELD:
            self.merge()

    def merge(self) -> None:
        for name, parts in self.counts.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate([n for _, n in parts]))
            self.counts[name] = [(keys, sums)]
        self.held = self.merged = sum(len(parts[0][0]) for parts in self.counts.values())

    def full(self) -> bool:
        return self.merged > HELD or len(self.numbers) + TOGETHER >= 1 << self.bits

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All counts as rows ``place, key, f``, by window. The key is the words from the third on, a tab,
        the first two, a tab and the language; windows with the same first two have one place."""
        self.merge()
        words = pa.array([None, *self.numbers], pa.string())
        hashes = np.array([0, *(zlib.crc32(w.encode()) for w in self.numbers)], np.int64)
        for name, [(keys, sums)] in self.counts.items():
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                codes = [(some >> (self.bits * (self.size - 1 - k))) & ((1 << self.bits) - 1) for k in range(self.size)]
                found = [words.take(pa.array(c)) for c in codes]
                texts = pc.binary_join_element_wise(*found[:2], " ", null_handling="skip")
                rest = found[2].fill_null("") if self.size > 2 else pa.array([""] * len(some))
                if self.size > 3:
                    rest = pc.binary_join_element_wise(rest, *found[3:], " ", null_handling="skip")
                keys_of = pc.binary_join_element_wise(rest, texts, name, "\t")
                place = (hashes[codes[0]] * 31 + hashes[codes[1]]) % PLACES
                columns = [pa.array(place.astype(np.int32)), keys_of, pa.array(sums[at : at + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(columns, ["place", "key", "f"])
        self.clear()


def counter(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size)
        for batch in parts:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // TOGETHER
            for some in np.split(np.arange(batch.num_rows), np.nonzero(np.diff(ends))[0] + 1):
                if len(some):
                    rows = batch.slice(int(some[0]), len(some))
                    windows.add(rows.column("lang").to_pylist(), rows.column("text"))
                if windows.full():
                    yield from windows.rows()
        yield from windows.rows()

    return batches


def frequencies(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """``lang, size, phrase, f`` of phrases of up to ``size`` words that occur ``least`` times, and
    the number of all words as the phrase of no words; written."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    # One narrow key packs well in the shuffle. All windows that begin alike go to one place.
    dealt = texts.mapInArrow(counter(size), "place int, key string, f long").repartition("place")
    counted, found = dealt.groupBy("place", "key").agg(F.sum("f").alias("f")), []
    rest, pair = F.substring_index("key", "\t", 1), F.expr("substring(key, instr(key, '\t') + 1)")
    for k in range(size, 2, -1):
        # The test is on the count, so that it is not moved below the sum and the shuffle is shared.
        # Words are counted in the rows that are frequent, which are few.
        often = F.when(F.col("f") >= least, (rest != "") & (F.size(F.split(rest, " ", -1)) == k - 2))
        frequent = counted.filter(often).select(rest.alias("rest"), pair.alias("key"), "f")
        phrase = F.concat_ws(" ", phrase_of_key(), "rest").alias("phrase")
        found.append(frequent.select(lang_of_key().alias("lang"), F.lit(k).alias("size"), phrase, "f"))
        if k > 3:
            shorter = F.concat(F.substring_index(rest, " ", k - 3), F.lit("\t"), pair)
            counted = counted.groupBy("place", shorter.alias("key")).agg(F.sum("f").alias("f"))
    counted = counted.groupBy("place", pair.alias("key")).agg(F.sum("f").alias("f"))
    word = lambda k: F.get(F.split(phrase_of_key(), " ", -1), F.lit(k))
    pairs = counted.select(lang_of_key().alias("lang"), word(0).alias("w1"), F.when(F.col("f") >= least, word(1)).alias("w2"), "f")
    sums = docs.sparkSession.sql(
        "SELECT lang, w1, w2, 2 - bit_count(grouping_id()) AS size, sum(f) AS f "
        "FROM {pairs} GROUP BY lang, ROLLUP (w1, w2)",
        pairs=pairs,
    )
    # A window that ends early has nulls: it is no phrase of that many words.
    ends = F.element_at(F.array(F.lit(""), "w1", "w2"), F.col("size").cast("int") + 1)
    shorter = sums.filter(ends.isNotNull() & ((F.col("f") >= least) | (F.col("size") == 0)))
    found.append(shorter.select("lang", F.col("size").cast("int").alias("size"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "f"))
    return materialize(union_all(found), "phrases")


def part_of(rows: DataFrame, parts: DataFrame, words: Column, name: str) -> DataFrame:
    """``rows`` with the count ``name`` of the phrase of ``words``.

    Only a frequent word can be part of many phrases. Words that make up ``1 / HOT`` of all words or
    more are ``HOT`` at most, so they are broadcast; rows they answer go on under keys of their own.
    """
    total = scalar_of(parts.filter("size = 0"), F.sum("f"))
    hot = parts.filter((F.col("size") == 1) & (F.col("f") * HOT >= total))
    hot = F.broadcast(hot.select(keyed(F.col("phrase")).alias("part"), F.col("f").alias("_hot")))
    left = rows.withColumn("part", keyed(F.concat_ws(" ", words))).join(hot, "part", "left")
    own = F.concat(F.lit("\t"), F.xxhash64("phrase").cast("string"))
    left = left.withColumn("part", F.when(F.col("_hot").isNull(), F.col("part")).otherwise(own))
    right = parts.filter("size > 0").select(keyed(F.col("phrase")).alias("part"), F.col("f").alias("_f"))
    return left.join(right, "part", "left").withColumn(name, F.coalesce("_hot", "_f")).drop("part", "_hot", "_f")


def scored(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of the candidates, each cut where it scores least."""
    candidates = found.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    parts = found.filter(f"size < {size}")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    words = F.split("phrase", " ", -1)
    cuts = part_of(cuts, parts, F.slice(words, F.lit(1), F.col("k")), "l")
    cuts = part_of(cuts, parts, F.slice(words, F.col("k") + 1, F.col("size")), "r")
    # Whole numbers of 38 digits: exact for up to 10^16 occurrences of a phrase.
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": exact("a") * exact("a"), "below": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr(f"CAST(above * {SCALE} div below AS BIGINT)"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(worst).select(
        "lang", "phrase", "size", "a", "worst.l", "worst.r", "worst.score"
    )


def inner_phrases(found: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a longer candidate that holds the phrase."""
    words = F.split("phrase", " ", -1)
    # Every run of two or more words, the whole excepted.
    runs = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))"
    )
    longer = found.filter("size > 2").select("lang", "size", "f", words.alias("words"))
    parts = longer.select("lang", "f", F.explode(F.array_distinct(runs)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, size: int = SIZE, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language its ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a``, ``l`` and ``r`` count the phrase and its parts where it is cut, ``n`` all words. A phrase
    that mostly occurs inside a longer candidate is left out.
    """
    found = frequencies(docs, size, least)
    kept = scored(found, size).join(inner_phrases(found), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (OF * F.col("longer") < HIDES * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = top_per_key(kept.drop("longer", "size"), ["lang"], order, top, "rank")
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), windows AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM windows
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM windows WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM windows WHERE i + 2 <= len(w)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.*, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
              JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE size = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank
  FROM worst w LEFT JOIN inner_phrases p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang) t ON t.lang = r.lang
WHERE r.rank <= 2000
"""
