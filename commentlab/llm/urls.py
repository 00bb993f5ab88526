"""URL filters: rules for hosts and paths, and naive Bayes over segmented names for the rest.

Names in hosts and paths are often several words run together. A unigram model of the pages'
own words splits them (Viterbi); multinomial naive Bayes over the words of host and path is
trained on the pages that rules decide and judges those that no rule fits.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed; a
url without words is allowed; ids may be null or repeated, each row is judged on its own; without
decided pages everything undecided is allowed; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import salted_join
from commentlab.session import materialize

from .common import LOWER, UPPER, whole

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

# Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Longer words are looked up by so many first characters, and the rest is compared.
HEAD = 24
# Stretches up to this length stand in many names; their rows go to so many places.
SHORT, SALTS = 3, 8
# Each character of a stretch that is no known word costs so many nats beyond a word seen once.
UNKNOWN = math.log(10)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``: the host in lower case, the path up to a query or fragment."""
    part = lambda i: F.regexp_extract(whole("url"), "://([^/?#]*)([^?#]*)", i)
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def decided(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``, else null.

    A rule fits its host and all hosts below it, if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names(host: Column, path: Column) -> Column:
    """Runs of letters in lower case, and ``0`` for each run of digits."""
    text = F.lower(F.regexp_replace(F.concat_ws("/", host, path), "[0-9]+", "/0/"))
    return F.array_remove(F.split(text, r"[^\p{L}0]+", -1), "")


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n`` over the text of all pages, without tags, and the names in all urls."""
    text = F.lower(F.regexp_replace(whole("html"), "<[^<>]*+>", " "))
    in_text = pages.select(F.explode(F.split(text, r"[^\p{L}]+", -1)).alias("word"))
    urls = parsed(pages)
    in_urls = urls.select(F.explode(names(F.col("host"), F.col("path"))).alias("word"))
    found = in_text.unionByName(in_urls).filter("word <> ''")
    return found.groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, words: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words, by (start, length) and count; ties prefer the word that starts first."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    known: list[list[tuple[int, float]]] = [[] for _ in best]
    for (start, length), n in words.items():
        known[start + length].append((start, math.log(n / total)))
    # The best unknown stretch so far: it grows by a character, or begins anew.
    unknown, begun = -math.inf, 0
    for end in range(1, len(name) + 1):
        if (anew := best[end - 1] - math.log(total)) > unknown:
            unknown, begun = anew, end - 1
        unknown -= UNKNOWN
        best[end], back[end] = unknown, begun
        for start, score in sorted(known[end]):
            score += best[start]
            if score > best[end] or (score == best[end] and start < back[end]):
                best[end], back[end] = score, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def split_rows(total: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [
                best_split(row["name"], {(w["start"], w["length"]): w["n"] for w in row["found"] if w["n"]}, total)
                for row in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return rows


def segmented(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` of distinct names. Every stretch of a name meets the counts in a join, so no
    vocabulary is sent around; what is gathered per name grows with its length alone."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    size = F.length("name")
    starts = found.select("name", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    room = size - F.col("start")
    ends = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), room))).alias("length"))
    stretches = ends.withColumn("word", F.substring("name", F.col("start") + 1, F.col("length")))
    salted = stretches.withColumn("salt", F.when(F.col("length") <= SHORT, F.pmod(F.xxhash64("name"), F.lit(SALTS))).otherwise(0))
    places = F.when(F.length("word") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    words = counts.filter(F.length("word") <= HEAD).select("word", "n", F.explode(places.cast("array<bigint>")).alias("salt"))
    short = salted.join(words, ["word", "salt"]).select("name", "start", "length", "n")
    # A longer word is found by its head; then the name must go on as the word does.
    heads = stretches.filter((F.col("length") == HEAD) & (room > HEAD)).select("name", "start", F.col("word").alias("head"))
    longer = counts.filter(F.length("word") > HEAD).select(F.left("word", F.lit(HEAD)).alias("head"), "word", "n")
    long = heads.join(longer, "head").withColumn("length", F.length("word"))
    long = long.filter(F.expr("substring(name, start + 1, length)") == F.col("word")).select("name", "start", "length", "n")
    known = short.unionByName(long).groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("found"))
    empty = F.array().cast("array<struct<start:int,length:int,n:bigint>>")
    every = found.join(known, "name", "left").select("name", F.coalesce("found", empty).alias("found"))
    return every.mapInArrow(split_rows(total), "name string, words array<string>")


def word_weights(tokens: DataFrame) -> DataFrame:
    """From ``word, verdict``: the log-odds for blocking of each ``word``, with add-one counts.

    Classes are taken as equally likely beforehand, as the rules say nothing about the rest.
    """
    block = F.col("verdict") == "block"
    seen = tokens.filter("verdict IS NOT NULL").groupBy("word")
    counts = materialize(seen.agg(F.count_if(block).alias("block"), F.count_if(~block).alias("allow")), "word-classes")
    sums = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("words")).first()
    share = lambda c: F.log((F.col(c) + 1) / F.lit(float(max(1, (sums[c] or 0) + sums["words"]))))
    return counts.select("word", (share("block") - share("allow")).alias("weight"))


def scores(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``host, path, score`` of distinct urls with words: log-odds for blocking."""
    urls = parsed(pages).select("host", "path").distinct().withColumn("verdict", decided(rules)["verdict"])
    named = urls.select("host", "path", "verdict", F.explode(names(F.col("host"), F.col("path"))).alias("name"))
    split = materialize(segmented(named.select("name").distinct(), word_counts(pages)), "names")
    # A few names (www, com) stand in most urls; their rows are salted.
    tokens = salted_join(named, split, "name").select("host", "path", "verdict", F.explode("words").alias("word"))
    tokens = materialize(tokens, "url-words")
    weighed = salted_join(tokens, materialize(word_weights(tokens), "word-weights"), "word")
    return weighed.groupBy("host", "path").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("score"))


def report(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page row: ``page_id, host, path, rule, verdict``."""
    judged = materialize(scores(pages, rules), "url-scores")
    rows = parsed(pages).withColumn("found", decided(rules))
    by_words = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_words).alias("verdict")
    )
