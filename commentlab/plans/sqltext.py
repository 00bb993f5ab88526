"""The text rules once more, as SQL strings, one step per rule."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from ..functions import lexicons as lx

SPACE = r"\s\pZ\x{85}\x{1c}-\x{1f}"
WORD = r"\pL\pN_"
EMOJI = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in lx.EMOJI_RANGES)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def gsub(expr: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, 'g')"


def squeeze(expr: str) -> str:
    return f"trim({gsub(expr, f'[{SPACE}]+')})"


def no_url(expr: str) -> str:
    return gsub(expr, rf"(?i)https?://[^{SPACE}]+|www\.[^{SPACE}]+")


def no_mention(expr: str) -> str:
    return gsub(expr, f"@[{WORD}]+")


def no_hashtag(expr: str) -> str:
    return gsub(expr, f"#[{WORD}]+")


def no_emoji(expr: str) -> str:
    return gsub(expr, f"[{EMOJI}]+")


def clean_aggressive(expr: str) -> str:
    t = no_emoji(no_hashtag(no_mention(no_url(f"lower(coalesce({expr}, ''))"))))
    t = gsub(t, r"\b\d+\b")
    return squeeze(gsub(t, r"[^a-z\s]"))


def clean_minimal(expr: str) -> str:
    t = no_emoji(no_mention(no_url(f"lower(coalesce({expr}, ''))")))
    return squeeze(gsub(t, rf"[^{WORD}{SPACE}.,!?;:'\"()\-]"))


def words(expr: str) -> str:
    return f"list_filter(string_split({squeeze(expr)}, ' '), lambda w: w <> '')"


def mapping(m: Mapping[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in m.items()) + "}"


def word_list(ws: Sequence[str]) -> str:
    return "[" + ", ".join(map(quote, ws)) + "]"


def replace_words(list_expr: str, m: Mapping[str, str]) -> str:
    return (
        f"list_filter(list_transform({list_expr}, lambda w: coalesce({mapping(m)}[w], w)), "
        "lambda w: w <> '')"
    )


def drop_stopwords(list_expr: str, stop: Sequence[str]) -> str:
    return (
        f"list_filter({list_expr}, lambda w: length(w) > 1 "
        f"AND NOT list_contains({word_list(stop)}, w))"
    )


def join_words(list_expr: str) -> str:
    return f"coalesce(array_to_string({list_expr}, ' '), '')"


def feature_words(expr: str, m: Mapping[str, str], stop: Sequence[str]) -> str:
    slang = join_words(replace_words(words(clean_aggressive(expr)), m))
    return drop_stopwords(words(slang), stop)


def has_match(expr: str, pattern: str) -> str:
    r"""Search where ``\b`` knows all letters, which DuckDB's own does not."""
    p = re.sub(r"\\b(?=[\w(])", lambda _: f"(?:^|[^{WORD}])", pattern)
    p = p.replace(r"\b", f"(?:$|[^{WORD}])")
    return f"regexp_matches({expr}, {quote(p)})"
