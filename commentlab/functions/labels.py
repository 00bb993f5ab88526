"""Labels, tolerant values and link ids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import strip


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_label(value: str | Column) -> Column:
    """A known spelling becomes its label; anything else is NULL."""
    key = F.lower(strip(value))
    out = F.lit(None).cast("string")
    for label in lx.LABELS:
        spellings = [k for k, v in lx.LABEL_ALIASES.items() if v == label]
        out = F.when(key.isin(spellings), F.lit(label)).otherwise(out)
    return out


def label_id(label: str | Column, labels: Sequence[str] = lx.LABELS) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), _col(label)), F.lit(0)).cast("int") - 1


def label_name(label_id: str | Column, labels: Sequence[str] = lx.LABELS) -> Column:
    out = F.lit(None).cast("string")
    for i, label in enumerate(labels):
        out = F.when(_col(label_id) == i, F.lit(label)).otherwise(out)
    return out


def strict_label(value: str | Column, labels: Sequence[str] = lx.LABELS) -> Column:
    """Upper-first form of the value; the job fails on a word outside the vocabulary."""
    form = F.initcap(strip(value))
    return F.when(form.isin(list(labels)), form).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(form, F.lit("NULL"))))
    )


def tolerant_bool(
    value: str | Column,
    true_words: Sequence[str] = lx.TRUE_WORDS,
    false_words: Sequence[str] = lx.FALSE_WORDS,
) -> Column:
    v = F.lower(strip(_col(value).cast("string")))
    return F.when(v.isin(list(true_words)), True).when(v.isin(list(false_words)), False)


def safe_int(value: str | Column, default: int = 0) -> Column:
    """A text of a whole number, or a number without its fraction, as bigint; else ``default``."""
    text = strip(_col(value).cast("string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def safe_int_of(value: str | Column, default: int = 0) -> Column:
    """``safe_int`` of a VARIANT: numbers lose their fraction, texts must be whole numbers."""
    v = _col(value)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_text = F.schema_of_variant(v) == "STRING"
    whole = F.coalesce(F.try_variant_get(v, "$", "bigint"), number.try_cast("bigint"))
    return F.when(is_text, safe_int(text, default)).otherwise(F.coalesce(whole, F.lit(default).cast("bigint")))


def sortable_confidence(value: str | Column) -> Column:
    """A number, or -1 where there is none, so that it sorts last."""
    return F.coalesce(_col(value).cast("string").try_cast("double"), F.lit(-1.0))


def error_pair(actual: str | Column, predicted: str | Column) -> Column:
    missing = F.lit("nan")
    return F.concat(
        F.coalesce(_col(actual), missing), F.lit(" → "), F.coalesce(_col(predicted), missing)
    )


def error_status(is_correct: str | Column) -> Column:
    c = _col(is_correct)
    return F.when(c, "Benar").when(~c, "Salah").otherwise("Tidak diketahui")


def extract_id(url: str | Column, patterns: Sequence[str] = lx.VIDEO_URL_PATTERNS) -> Column:
    """Group 1 of the first pattern that matches, else NULL."""
    u = strip(_col(url))
    return F.coalesce(*[F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in patterns])


def is_valid_id(value: str | Column, pattern: str = lx.VIDEO_ID_PATTERN) -> Column:
    return F.coalesce(_col(value).rlike(pattern), F.lit(False))


def response_class(status: str | Column, reasons: str | Column) -> Column:
    """What to do with an answer of the service, given its status and error reasons."""
    quota = F.exists(F.coalesce(_col(reasons), F.array().cast("array<string>")),
                     lambda r: r.isin(list(lx.QUOTA_REASONS)))
    s = _col(status)
    return (
        F.when((s == 403) & quota, "quota")
        .when(s == 403, "forbidden")
        .when(s != 200, "error")
        .otherwise("ok")
    )


def agreement_band(kappa: str | Column) -> Column:
    """Landis-Koch words for a kappa value."""
    k = _col(kappa)
    return (
        F.when(k < 0.0, "poor (lebih buruk dari acak)")
        .when(k < 0.2, "slight")
        .when(k < 0.4, "fair")
        .when(k < 0.6, "moderate")
        .when(k < 0.8, "substantial")
        .when(k.isNotNull(), "almost perfect")
    )
