"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get functions of this module with the task and need not have it installed.
register_pickle_by_value(sys.modules[__name__])

# White space of a word split: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does just that for pure ASCII, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters other than white space, in order."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_key(text: str = "text") -> Column:
    """With the id, names a row by its content: rows alike in both get the same results."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality on all keys, where null equals null."""
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[key])
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so that helper columns never clash with its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame) -> DataFrame:
    """All columns inside one struct ``row``, out of the way of helper columns of any name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    """The columns of ``row`` again, then ``more``."""
    return df.select("row.*", *more)


CHUNK = 256


def running_sums(numbers: Column) -> Column:
    """Sum of each element and those before it. Works in chunks, so long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def by_chunk(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(CHUNK)).cast("int"))
        chunks = F.transform(starts, lambda k: F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)))

        def offsets(parts: Column) -> Column:
            def join(totals: Column) -> Column:
                before = F.transform(totals, lambda _, k: F.when(k == 0, zero).otherwise(total(F.slice(totals, 1, k))))
                return F.flatten(
                    F.zip_with(
                        parts, before,
                        lambda c, o: F.transform(c, lambda _, i: o + total(F.slice(c, 1, i + 1))),
                    )
                )

            return let(F.transform(parts, total), join)

        return let(chunks, offsets)

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(numbers, by_chunk))


SPAN = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"
MARK, OTHER = "\x01", "\x02"


def spans(text: Column, pattern: str, before: int = 40, after: int = 20) -> Column:
    """All leftmost matches that do not overlap, with the characters around them.

    Places are code points, the end is exclusive. Matches are put between marks and the text is
    split at those, so that places are sums of lengths and the work grows with the text alone.
    ``before`` and ``after`` reach to the neighbouring match at most. The pattern must match
    neither the empty text nor control characters.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    marked = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def placed(parts: Column) -> Column:
        def build(ends: Column) -> Column:
            places = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
            return F.transform(
                places,
                lambda i: F.struct(
                    ends[i - 1].alias("start"), ends[i].alias("end"), parts[i].alias("found"),
                    F.right(parts[i - 1], F.lit(before)).alias("before"),
                    F.left(parts[i + 1], F.lit(after)).alias("after"),
                ),
            ).cast(SPAN)

        lengths = F.transform(parts, lambda x: F.length(x).cast("long"))
        return F.when(F.size(parts) < 3, F.array().cast(SPAN)).otherwise(let(running_sums(lengths), build))

    return let(marked, placed)


def of_kind(found: Column, kind: str) -> Column:
    """Spans as ``struct<kind, start, end>``."""
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(
        ",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def remembered(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker, kept between its tasks.

    Functions that come with a task have no module of their own on the worker, so what it
    remembers hangs on one made here.
    """
    memo = sys.modules.setdefault("_worker_memo", types.ModuleType("_worker_memo")).__dict__
    if name not in memo:
        memo[name] = make()
    return memo[name]
