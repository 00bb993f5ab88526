"""Text operators as column expressions: no Python worker touches a row.

Space, word and letter classes follow the Unicode rules of the source data, which Java's
short classes do not, so they are written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

SPACE = r"\s\p{Z}\x{85}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION = rf"@[{WORD}]+"
HASHTAG = rf"#[{WORD}]+"
KEPT_PUNCTUATION = r".,!?;:'\"()\-"


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def emoji_class(ranges: Sequence[tuple[int, int]] = lx.EMOJI_RANGES) -> str:
    """The inside of a character class that matches the given code points."""
    return "".join(
        rf"\x{{{lo:X}}}" if lo == hi else rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in _merged(ranges)
    )


def _text(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: str | Column) -> Column:
    """Every run of white space becomes one space; none at the ends.

    Single spaces, by far the most common run, do not match and are not rewritten.
    """
    run = rf"(?: [{SPACE}]|[{SPACE}&&[^ ]])[{SPACE}]*"
    return F.trim(F.regexp_replace(_text(text), run, " "))


def strip(text: str | Column) -> Column:
    """The text without white space of any kind at its ends; null stays null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: str | Column) -> Column:
    """Whether a text has nothing but white space; true for null."""
    return ~_text(text).rlike(f"[^{SPACE}]")


def strip_urls(text: str | Column) -> Column:
    t = _text(text)
    return F.regexp_replace(t, f"(?i){URL}", " ")


def strip_mentions(text: str | Column) -> Column:
    return F.regexp_replace(_text(text), MENTION, " ")


def strip_hashtags(text: str | Column) -> Column:
    return F.regexp_replace(_text(text), HASHTAG, " ")


def strip_emoji(text: str | Column, ranges: Sequence[tuple[int, int]] = lx.EMOJI_RANGES) -> Column:
    return F.regexp_replace(_text(text), f"[{emoji_class(ranges)}]+", " ")


def clean_aggressive(text: str | Column) -> Column:
    """Lower case, no links, no mentions, no tags, and nothing but a-z and single spaces.

    Emoji and numbers need no step of their own: the last class removes them as well.
    """
    t = strip_urls(F.lower(_text(text)))
    t = F.regexp_replace(t, rf"[@#][{WORD}]+", " ")
    return F.trim(F.regexp_replace(t, "[^a-z]+", " "))


def clean_minimal(
    text: str | Column, ranges: Sequence[tuple[int, int]] = lx.EMOJI_RANGES
) -> Column:
    """Lower case, no links, mentions or emoji; letters, digits and plain punctuation stay."""
    plain = rf"[^{WORD}{KEPT_PUNCTUATION}]+"
    with_emoji = rf"[{emoji_class(ranges)}[^{WORD}{KEPT_PUNCTUATION}]]+"
    # The wide class is slow, and only texts with a code point that high can need it.
    first = min(lo for lo, _ in ranges)
    high = rf"[^\x00-\x{{{first - 1:X}}}]"

    def cleaned(t: Column) -> Column:
        return F.when(t.rlike(high), F.regexp_replace(t, with_emoji, " ")).otherwise(F.regexp_replace(t, plain, " "))

    return F.trim(once(strip_mentions(strip_urls(F.lower(_text(text)))), cleaned))


def tokens(text: str | Column) -> Column:
    """Words between white space; blank text gives an empty array."""
    return F.filter(F.split(_text(text), rf"[{SPACE}]+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """Number of words; blank text has none."""

    def count(t: Column) -> Column:
        gaps = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return F.when(F.length(t) == 0, F.lit(0)).otherwise(gaps + 1)

    return once(squeeze(text), count)


def replace_words(words: Column, mapping: Mapping[str, str]) -> Column:
    """Each word looked up once; empty replacements go, two-word ones stay one element.

    The set test is a hash probe, so words outside the mapping never reach the map.
    """
    keys = [k for k, v in mapping.items() if k != v]
    if not keys:
        return words
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, mapping[k])])
    mapped = F.transform(words, lambda w: F.when(w.isin(keys), F.element_at(table, w)).otherwise(w))
    return F.filter(mapped, lambda w: w != "")


def normalize_slang(text: str | Column, mapping: Mapping[str, str] = lx.SLANG) -> Column:
    return F.array_join(replace_words(tokens(text), mapping), " ")


def drop_stopwords(words: Column, stopwords: Sequence[str] = lx.STOPWORDS) -> Column:
    """Without the given words and without one-letter words."""
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stopwords)))


def feature_tokens(
    text: str | Column,
    mapping: Mapping[str, str] = lx.SLANG,
    stopwords: Sequence[str] = lx.STOPWORDS,
) -> Column:
    """Words of the aggressive path before stemming."""
    words = F.filter(F.split(clean_aggressive(text), " "), lambda w: w != "")
    replaced = replace_words(words, mapping)
    if any(" " in v for v in mapping.values()):
        replaced = F.flatten(F.transform(replaced, lambda w: F.split(w, " ")))
    return drop_stopwords(replaced, stopwords)


def feature_text(
    text: str | Column,
    mapping: Mapping[str, str] = lx.SLANG,
    stopwords: Sequence[str] = lx.STOPWORDS,
) -> Column:
    return F.array_join(feature_tokens(text, mapping, stopwords), " ")


def is_readable(text: str | Column) -> Column:
    """At least three characters, three Latin letters in a row, half of it letters.

    Three letters in a row imply three characters, so that test needs no step of its own.
    """
    t = _text(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(t, f"[{SPACE}]+", ""))
    return t.rlike("[A-Za-z]{3}") & (letters * 2 >= solid)


def dedup_key(text: str | Column) -> Column:
    return F.lower(squeeze(text))


def normalize_light(text: str | Column) -> Column:
    """Zero-width and no-break spaces count as spaces; runs of white space are one space."""
    return F.trim(F.regexp_replace(_text(text), rf"[{SPACE}\x{{200B}}]+", " "))


def first_nonempty(*texts: str | Column) -> Column:
    cols = [F.col(t) if isinstance(t, str) else t for t in texts]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def is_candidate(text: str | Column, min_words: int = 3) -> Column:
    """Worth labelling: not blank, has a letter or digit, has enough words."""
    t = normalize_light(text)
    return (t != "") & t.rlike(r"[\p{L}\p{N}]") & (word_count(t) >= min_words)


def word_ngrams(words: Column, n: int = 2) -> Column:
    """Single words, then runs of 2 up to ``n`` words.

    Runs of k come from those of k-1 zipped with the words k places on. Pass a plain column:
    it is read a few times.
    """
    runs, parts = words, [words]
    for k in range(2, n + 1):
        count = F.greatest(F.size(words) - (k - 1), F.lit(0))
        longer = F.slice(words, k, count)
        runs = F.zip_with(F.slice(runs, 1, count), longer, lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(runs)
    return F.concat(*parts)


def char_ngrams(words: Column, lo: int = 3, hi: int = 5) -> Column:
    """Letter runs inside each word padded by one space; a shorter word comes out once."""
    none = F.array().cast("array<string>")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
            runs = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            # A word shorter than the shortest run comes out whole, and only once.
            return runs if n == lo else F.when(size >= n, runs).otherwise(none)

        return F.concat(*[of_length(n) for n in range(lo, hi + 1)])

    return F.flatten(F.transform(words, grams))


def counted(terms: Column) -> Column:
    """Each distinct element of an array with its count, as ``array<struct<term, tf>>``.

    The array is sorted and cut into runs, so a row needs no memory beyond its own.
    """

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))

        def sized(firsts: Column) -> Column:
            ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(s)))
            return F.zip_with(firsts, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("long").alias("tf")))

        return F.when(F.size(s) > 0, once(starts, sized))

    return once(F.sort_array(terms), runs)


def merge_negation(text: str | Column, negators: Sequence[str] = lx.NEGATORS) -> Column:
    """A negator and the word after it become one word; works left to right."""
    pattern = rf"(^| )({'|'.join(negators)}) ([^ ]+)"
    return F.regexp_replace(squeeze(text), pattern, "$1$2_$3")


def plain_words(pattern: str) -> list[str]:
    """The words of a pattern like ``a|\\bb\\b`` or ``\\b(a|b)\\b``; none if it is of another form."""
    inner = re.sub(r"^\\b\((.*)\)\\b$", r"\1", pattern)
    words = [w.removeprefix(r"\b").removesuffix(r"\b") for w in inner.split("|")]
    return words if all(re.fullmatch(r"[\w ]+", w) for w in words) else []


def domain_flags(
    text: str | Column, patterns: Mapping[str, str] = lx.DOMAIN_PATTERNS
) -> dict[str, Column]:
    """One 0/1 column per pattern. A pattern that is a list of plain words is only searched in texts that
    contain one of them, which costs far less to test."""
    t = F.lower(_text(text))

    def found(pattern: str) -> Column:
        hit, words = t.rlike(f"(?U){pattern}"), plain_words(pattern)
        return F.when(reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words]), hit).otherwise(False) if words else hit

    return {name: found(p).cast("int") for name, p in patterns.items()}


def flag_interactions() -> dict[str, Column]:
    """Products of the flags; needs the flag columns of ``domain_flags``."""
    hostile = F.greatest("punish", "attack")
    return {
        "accuser_hostile": F.col("accuser") * hostile,
        "subject_hostile": F.col("subject") * hostile,
        "accuser_slander": F.col("accuser") * F.col("slander"),
        "verdict_false": F.col("false_claim"),
        "verdict_genuine": F.col("genuine"),
    }


def preview(text: str | Column, size: int = 170) -> Column:
    t = _text(text)
    cut = F.substring(t, 1, size)
    return F.when(F.length(t) > size, F.concat(cut, F.lit("..."))).otherwise(t)


def matches_keyword(text: str | Column, keyword: str, literal: bool = False) -> Column:
    """Search without regard to case: a regular expression, or plain text if ``literal``."""
    t = _text(text)
    if literal:
        return F.contains(F.lower(t), F.lit(keyword.lower()))
    return t.rlike(f"(?iu){keyword}")


def stage_trace(
    text: str,
    mapping: Mapping[str, str] = lx.SLANG,
    stopwords: Sequence[str] = lx.STOPWORDS,
) -> dict[str, Column]:
    """Every stage of the aggressive path side by side."""
    lower = F.lower(_text(text))
    no_url = strip_urls(lower)
    no_mention = strip_mentions(no_url)
    no_hashtag = strip_hashtags(no_mention)
    clean = F.trim(F.regexp_replace(no_hashtag, "[^a-z]+", " "))
    slang = normalize_slang(clean, mapping)
    words = tokens(slang)
    return {
        "stage_lower": squeeze(lower),
        "stage_no_url": squeeze(no_url),
        "stage_no_mention": squeeze(no_mention),
        "stage_no_hashtag": squeeze(no_hashtag),
        "stage_clean": clean,
        "stage_slang": slang,
        "stage_n_tokens": F.size(words),
        "stage_feature": F.array_join(drop_stopwords(words, stopwords), " "),
    }

