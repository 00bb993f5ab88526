"""Benchmark decontamination by a positional inverted index of the training texts.

``build_index`` stores postings (term, document, position) of the training tokens. Every task
writes its own segment, sorted by term, so no term's list meets in one task however frequent
the term is. ``phrase_matches`` looks up the rarest term of each test phrase, shifts the
positions by the term's place in the phrase and intersects with the shifted list of the next
rarest; alignments that survive are confirmed word by word on the whole text.
``proximity_matches`` asks instead that all terms stand close to an occurrence of the rarest.

Defined cases: a null text has no words; a null or repeated id is an id like any other, rows
alike in id and text share one result; test rows without words match nothing; test rows without an id
match like others, count as one item together and are not named; repeated test rows count once; ids
are compared as strings; empty tables give empty matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import explode_rows
from commentlab.session import materialize

from .common import ascii_lower, packed, same, text_key, unpacked, whole

PHRASE = 10
# What stands between words: ASCII other than digits and a-z, once A-Z is in lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "text_key"]


def test_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS, -1), "")


def phrases_of(benchmark: DataFrame, size: int = PHRASE) -> DataFrame:
    """Distinct test texts: ``item`` (a key), ``ids`` of its rows, ``words``, ``width`` of its phrases."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").distinct()
    # Inside structs, nulls are collected too.
    texts = rows.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("rows")).select("text", F.col("rows.id").alias("ids"))
    items = texts.select(F.xxhash64("text").alias("item"), "ids", test_words(whole("text")).alias("words"))
    return items.filter(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(size)))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings ``term, doc_id, text_key, pos``, written to the shared folder in sorted segments.

    ``terms`` limits the index to the terms that will be asked for; without it all are stored.
    """
    rows = docs.select("doc_id", text_key().alias("text_key"), test_words(whole("text")).alias("words"))
    postings = explode_rows(rows, DOC, "words", "term", "pos")
    if terms is not None:
        postings = postings.join(terms, "term", "left_semi")
    return materialize(postings.sortWithinPartitions(F.xxhash64("term")), "postings")


def rarest_pairs(index: DataFrame, items: DataFrame) -> DataFrame:
    """For each phrase its two rarest terms and their offsets; phrases that share both in one row.

    A phrase with a term that never occurs can not match and is left out here.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    starts = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))))
    terms = starts.select(
        "item", "start", "width", F.posexplode(F.slice("words", F.col("start") + 1, F.col("width"))).alias("at", "term")
    ).distinct()
    ranked = (
        terms.join(counts, "term")
        .groupBy("item", "start", "width")
        .agg(F.array_sort(F.collect_list(F.struct("n", "term", (F.col("at") + F.col("start")).alias("at")))).alias("t"))
        .filter(F.size("t") == F.col("width"))
    )
    first, second = F.col("t")[0], F.col("t")[F.when(F.size("t") > 1, 1).otherwise(0)]
    return ranked.groupBy(
        "item", first["term"].alias("term"), first["at"].alias("at"),
        second["term"].alias("next_term"), second["at"].alias("next_at"),
    ).agg(F.array_sort(F.collect_list("start")).alias("starts"))


def alignments(index: DataFrame, items: DataFrame) -> DataFrame:
    """Where a test text may lie over a document: ``doc_id, text_key, item, base, starts``.

    ``base`` is the document position of the item's first word (it may be negative), ``starts``
    are the phrases whose two rarest terms both stand in their places there.
    """
    pairs = materialize(rarest_pairs(index, items), "pairs")
    found = index.join(pairs, "term").select(
        *DOC, "item", (F.col("pos") - F.col("at")).alias("base"), "next_term", "next_at", "starts"
    )
    wanted = found.withColumn("next_pos", F.col("base") + F.col("next_at"))
    lists = index.join(pairs.select(F.col("next_term").alias("term")).distinct(), "term", "left_semi")
    lists = lists.select(*DOC, F.col("term").alias("next_term"), F.col("pos").alias("next_pos"))
    both = wanted.join(lists, same(wanted, lists, [*DOC, "next_term", "next_pos"]), "left_semi")
    return both.groupBy(*DOC, "item", "base").agg(
        F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")
    )


def matched_rows(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE) -> DataFrame:
    """Each document as ``row``, its number of words, and ``hits``: its exact phrase matches as
    ``array<struct<ids, start, width>>``, where ``start`` is the word position."""
    texts = materialize(phrases_of(benchmark, size), "items")
    terms = materialize(texts.select(F.explode("words").alias("term")).distinct(), "terms")
    index = build_index(docs, terms)
    near = alignments(index, texts).join(texts, "item").groupBy(*DOC).agg(
        F.collect_list(F.struct("ids", "base", "starts", F.col("words").alias("test"), "width")).alias("near")
    )
    rows = packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "text_key": text_key("row.text")})
    joined = rows.join(near, same(rows, near, DOC), "left").select(
        "row", test_words(whole("row.text")).alias("words"), "near"
    )

    def confirmed(a: Column) -> Column:
        def fits(s: Column) -> Column:
            here = F.slice(F.col("words"), a["base"] + s + 1, a["width"])
            return (a["base"] + s >= 0) & (here == F.slice(a["test"], s + 1, a["width"]))

        return F.transform(
            F.filter(a["starts"], fits),
            lambda s: F.struct(a["ids"].alias("ids"), (a["base"] + s).alias("start"), a["width"].alias("width")),
        )

    kind = "array<struct<ids:array<string>,start:int,width:int>>"
    hits = F.when(F.col("near").isNull(), F.array().cast(kind)).otherwise(
        F.flatten(F.transform("near", confirmed)).cast(kind)
    )
    return joined.select("row", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE) -> DataFrame:
    """Exact phrase matches: ``doc_id, item_id, start, width``, one row per occurrence."""
    found = matched_rows(docs, benchmark, size).select(F.col("row.doc_id").alias("doc_id"), F.explode("hits").alias("h"))
    return found.select("doc_id", F.explode("h.ids").alias("item_id"), "h.start", "h.width").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE) -> DataFrame:
    """The documents without any exact phrase match, with their own columns."""
    return unpacked(matched_rows(docs, benchmark, size).filter(F.size("hits") == 0))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, reach: int = 20, size: int = PHRASE) -> DataFrame:
    """Looser matches: all terms of a phrase within ``reach`` words of an occurrence of its rarest.

    Gives ``doc_id, item_id, phrase_start, pos`` (position of the rarest term). Positions are
    compared inside blocks of ``reach`` words, so a frequent term meets only its neighbours.
    """
    texts = materialize(phrases_of(benchmark, size), "items")
    index = build_index(docs, texts.select(F.explode("words").alias("term")).distinct())
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    starts = texts.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))))
    phrase = F.array_distinct(F.slice("words", F.col("start") + 1, F.col("width")))
    terms = starts.select("item", "start", F.explode(phrase).alias("term"), F.size(phrase).alias("n_terms"))
    ranked = (
        terms.join(counts, "term").groupBy("item", "start", "n_terms")
        .agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t"))
        .filter(F.size("t") == F.col("n_terms"))
        .select("item", "start", "n_terms", F.col("t.term").alias("terms"))
    )
    anchors = index.join(
        ranked.withColumn("term", F.col("terms")[0]), "term"
    ).select(*DOC, "item", "start", "n_terms", F.col("pos").alias("at"), "terms")
    asked = anchors.select(
        *DOC, "item", "start", "n_terms", "at", F.explode("terms").alias("term")
    ).withColumn("block", F.explode(F.expr(f"array(at div {reach} - 1, at div {reach}, at div {reach} + 1)")))
    lists = index.withColumn("block", F.expr(f"pos div {reach}"))
    close = asked.join(
        lists, same(asked, lists, [*DOC, "term", "block"]) & (F.abs(lists["pos"] - asked["at"]) <= reach)
    ).select(asked["doc_id"], asked["text_key"], "item", "start", "n_terms", "at", asked["term"])
    full = (
        close.distinct().groupBy(*DOC, "item", "start", "n_terms", "at").agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("n_terms"))
    )
    return full.join(texts.select("item", F.explode("ids").alias("item_id")), "item").select(
        "doc_id", "item_id", F.col("start").alias("phrase_start"), F.col("at").alias("pos")
    ).distinct()


def report(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = matched_rows(docs.select("doc_id", "text"), benchmark, size)
    inside = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["width"] - 1)))
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))))
    some = F.size("hits") > 0
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words",
        F.when(some, F.size(inside)).otherwise(0).cast("long").alias("n_hit"),
        F.when(some, ids).otherwise(F.array().cast("array<string>")).alias("named"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("named").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "named"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
