"""Secret scans: rules for known shapes, and Markov models of characters for the rest.

Two first-order Markov models, of random strings and of ordinary identifiers, are trained from
labelled samples. A run of 12 or more key characters is a secret if its log-likelihood ratio says so,
in all and in the mean per step; if it does not, each of its pieces between ``/``, ``=``, ``-`` and the like
is judged on its own. No shape is asked for besides the length.

Defined cases: a null text has no spans; ids may be null or repeated, each row is judged on its
own; other columns are ignored; an empty table gives no rows. A model trained without samples
gives ratio 0 to every string, so it adds no span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, let, of_kind, span_text, spans, whole

# The shapes of the base rules.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
ASSIGN_VALUE = 12

# What the models judge: runs of key characters, and the pieces of a run.
RUN, PIECE = r"[A-Za-z0-9+/_=-]{12,}+", r"[A-Za-z0-9]{12,}+"
# Least log-likelihood ratio in nats, per step in the mean and in all: random strings are rare.
THRESHOLD, EVIDENCE = 0.5, 10.0
# Labelled documents used for training at most, those with the smallest id hash first.
TRAINING_ROWS = 2000

FIRST, CELLS = 32, 96  # printable ASCII; other characters share cell 0
SMOOTHING = 0.5


@dataclass(frozen=True)
class MarkovPair:
    """``ratios[a * CELLS + b]``: log of how much likelier b follows a in random strings."""

    ratios: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """Sum of the ratios of all steps; null for fewer than two characters."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")

        def total(cells: Column) -> Column:
            steps = F.sequence(F.lit(1), F.size(cells) - 1)
            return let(
                table,
                lambda t: F.aggregate(
                    steps, F.lit(0.0), lambda acc, i: acc + t[cells[i - 1] * CELLS + cells[i]]
                ),
            )

        return F.when(F.length(token) > 1, let(cells_of(token), total))


def cells_of(token: Column) -> Column:
    code = lambda c: F.ascii(c) - FIRST
    chars = F.array_remove(F.split(token, ""), "")
    return F.transform(chars, lambda c: F.when(code(c).between(0, CELLS - 1), code(c)).otherwise(0))


def train(samples: DataFrame) -> MarkovPair:
    """From ``text`` and ``random`` (true for random strings). The counts have a row per pair of
    characters and class at most, whatever the number of samples."""
    cells = samples.filter("text IS NOT NULL AND random IS NOT NULL").select("random", cells_of(F.col("text")).alias("c"))
    steps = cells.filter(F.size("c") > 1).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.col("c")[i - 1] * CELLS + F.col("c")[i])).alias("step")
    )
    counts = {True: [0] * CELLS**2, False: [0] * CELLS**2}
    for r in steps.groupBy("random", "step").count().collect():
        counts[r["random"]][r["step"]] = r["count"]
    logs = {}
    for label, n in counts.items():
        rows = [sum(n[a * CELLS : (a + 1) * CELLS]) for a in range(CELLS)]
        logs[label] = [math.log((x + SMOOTHING) / (rows[i // CELLS] + SMOOTHING * CELLS)) for i, x in enumerate(n)]
    return MarkovPair(tuple(round(a - b, 6) for a, b in zip(logs[True], logs[False])))


def labelled_samples(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Samples from labelled documents: their words, alone and joined as names are, are ordinary;
    digests of their ids, written in the usual alphabets, are random."""
    ids = labels.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.join(ids, "doc_id").select("doc_id", whole("text").alias("text"))
    clean = text
    for shape in (ASSIGN, ACCESS, HEX):
        clean = clean.withColumn("text", F.regexp_replace("text", shape, " "))
    names = clean.select(F.array_remove(F.split("text", r"[^A-Za-z0-9]+"), "").alias("w"))
    names = names.filter(F.size("w") > 2).select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - 2),
                    lambda i: F.array(
                        F.col("w")[i - 1],
                        F.array_join(F.slice("w", i, 3), "_"), F.lower(F.array_join(F.slice("w", i, 3), "-")),
                        F.array_join(F.slice("w", i, 3), "/"), F.array_join(F.slice("w", i, 2), "="),
                        F.array_join(F.transform(F.slice("w", i, 3), F.initcap), ""),
                        F.concat(F.array_join(F.slice("w", i, 2), "_"), F.lit("_"), (i % 100).cast("string")),
                    ),
                )
            )
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    digest = lambda n: F.sha2(F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")), 256)
    url_safe = lambda c: F.translate(c, "+/=", "-_")
    random = ids.select(
        F.explode(
            F.array(
                digest("hex"), F.upper(F.left(digest("upper"), F.lit(32))), F.base64(F.unhex(digest("base64"))),
                url_safe(F.base64(F.unhex(digest("url")))), F.regexp_replace(F.base64(F.unhex(digest("word"))), "[+/=]", ""),
            )
        ).alias("text"),
        F.lit(True).alias("random"),
    )
    return names.unionByName(random)


def find(docs: DataFrame, model: MarkovPair, threshold: float = THRESHOLD) -> DataFrame:
    """Adds to ``doc_id`` the arrays ``assign``, ``access``, ``hex`` (base rules) and ``random``
    (the models) of spans ``struct<kind, start, end>``."""
    text = whole("text")
    value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= ASSIGN_VALUE

    def likely(found: Column) -> Column:
        return let(model.score(found), lambda x: (x > EVIDENCE) & (x > threshold * (F.length(found) - 1)))

    def pieces(run: Column) -> Column:
        inside = F.filter(spans(run["found"], PIECE, 0, 0), lambda p: likely(p["found"]))
        return F.transform(
            inside,
            lambda p: F.struct(
                (run["start"] + p["start"]).alias("start"), (run["start"] + p["end"]).alias("end"),
                p["found"].alias("found"), p["before"].alias("before"), p["after"].alias("after"),
            ),
        )

    def judged(run: Column) -> Column:
        parted = run["found"].rlike("[^A-Za-z0-9]")
        return F.when(likely(run["found"]), F.array(run)).when(parted, pieces(run)).otherwise(F.array().cast(SPAN))

    random = F.flatten(F.transform(spans(text, RUN, 0, 0), judged))
    return docs.select(
        "doc_id",
        of_kind(F.filter(spans(text, ASSIGN), value), "assign").alias("assign"),
        of_kind(spans(text, ACCESS), "access").alias("access"),
        of_kind(spans(text, HEX), "hex").alias("hex"),
        of_kind(random, "random").alias("random"),
    )


def by_start(*kinds: Column) -> Column:
    """Spans by start, then in the order of the kinds."""
    ranked = [
        F.transform(k, lambda s, r=i: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        for i, k in enumerate(kinds)
    ]
    return F.array_sort(F.concat(*ranked))


def report(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """Per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    base = [F.col("assign"), F.col("access"), F.col("hex")]
    return find(docs, model).select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{n}") for n, c in zip(("assign", "access", "hex"), base)),
        F.sha2(span_text(by_start(*base)), 256).alias("base_sha256"),
        span_text(by_start(*base, F.col("random"))).alias("spans"),
    )
