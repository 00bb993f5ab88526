"""Personal data: shapes propose spans, checksums confirm them, words nearby move the score.

Each kind has a pattern, a check and a base score. A passed checksum (Luhn, mod 97) or a word of
the kind's context within a few characters raises the score. The base kinds (email, ip, card,
phone) are kept whatever their score; the others need ``KEEP``.

Defined cases: a null text has no spans; ids may be null or repeated, each row is judged on its
own; other columns are ignored; an empty table gives no rows. Kinds are found independently, so
spans of two kinds may overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, span_text, spans, whole

KEEP = 0.7
NEARBY = 0.3


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    places = F.transform(
        F.array_remove(F.split(F.reverse(number), ""), ""),
        lambda d, i: d.cast("int") * (1 + i % 2) - F.when(d.cast("int") * (1 + i % 2) > 9, 9).otherwise(0),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, letters and digits alone, has remainder 1 by 97."""
    turned = F.concat(F.substring(account, 5, 64), F.left(account, F.lit(4)))
    values = F.transform(
        F.array_remove(F.split(turned, ""), ""),
        lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    )
    return rest == 1


def bytes_at_most_255(found: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(F.left(short, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), fits)


def n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda found: F.length(digits(found)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float  # of a span that passes its check
    context: str  # words that make the kind likelier
    base: bool = False


# The patterns and limits of the four base kinds. Quantifiers that never give back
# what they took and looks behind keep long runs of one class from being tried again and again.
BASE = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda f: F.lit(True), 0.9, "e-?mail|contact|write|mailto", True,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", bytes_at_most_255, 0.7,
        "ip|address|host|server|client|login", True,
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){15,}+", lambda f: n_digits(16, 19)(f) & luhn(digits(f)), 0.8,
        "card|visa|master|credit|debit|pay", True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", n_digits(8, 15), 0.7,
        "phone|tel|call|mobile|fax|whatsapp", True,
    ),
)

# Kinds that the method adds.
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        lambda f: mod97(F.regexp_replace(f, " ", "")), 0.9, "iban|bank|account|konto|compte|cuenta",
    ),
    Kind(
        "short_card", r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
        lambda f: luhn(digits(f)), 0.5, "card|visa|master|amex|credit|debit|pay",
    ),
    Kind(
        "social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda f: ~f.rlike("^(000|666|9)|-00-|-0000$"), 0.6, "ssn|social|security|tax",
    ),
    Kind(
        "local_phone", r"(?<![0-9+).-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        lambda f: F.lit(True), 0.5, "phone|tel|call|mobile|fax|whatsapp",
    ),
)


def scored(text: Column, kind: Kind) -> Column:
    """The spans of one kind that pass its check: ``array<struct<kind, start, end, score>>``."""
    near = rf"(?i)(?<![\p{{L}}])(?:{kind.context})"

    def with_score(s: Column) -> Column:
        context = s["before"].rlike(near) | s["after"].rlike(near)
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (F.lit(kind.score) + F.when(context, NEARBY).otherwise(0.0)).alias("score"),
        )

    return F.transform(F.filter(spans(text, kind.pattern), lambda s: kind.check(s["found"])), with_score)


def find(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id`` and for each kind an array of its spans; added kinds need a score of ``keep``."""
    text = whole("text")
    return docs.select(
        "doc_id",
        *(scored(text, k).alias(k.name) for k in BASE),
        *(F.filter(scored(text, k), lambda s: s["score"] >= keep).alias(k.name) for k in MORE),
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id``, the counts of the base kinds, ``base_sha256``, ``spans``."""
    base = F.concat(*(F.col(k.name) for k in BASE))
    return find(docs).select(
        "doc_id",
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.concat(*(F.col(k.name) for k in (*BASE, *MORE)))).alias("spans"),
    )
