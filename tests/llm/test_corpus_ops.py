"""Collocations, hard negatives and language-model scores: against plain Python and SQL."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import ordered, pairs, rows_of
from pyspark.sql import functions as F

from commentlab.llm import collocations, language_model, negatives

# --- collocations ------------------------------------------------------------------------


def plain_collocations(docs, size, least, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting every n-gram of every piece."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", brute.lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, size + 1):
                c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inner[p[i : i + n]] = max(inner[p[i : i + n]], a)
        rows = []
        for p, a in found.items():
            if 100 * inner[p] >= 50 * a and inner[p]:
                continue
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize(("size", "least", "top"), [(3, 2, 10**6), (4, 3, 7), (2, 2, 50), (3, 2, 1500)])
def test_collocations_equal_plain_counts(monkeypatch, real_docs, size, least, top):
    docs = real_docs.filter("doc_id < 60")
    # Small texts and few windows at a time: counts come in several parts.
    monkeypatch.setattr(collocations, "TOGETHER", 5000)
    monkeypatch.setattr(collocations, "HELD", 20_000)
    monkeypatch.setattr(collocations, "HOT", 20)
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], size, least, top)
    assert rows_of(collocations.collocations(docs, size, least, top)) == ordered(want)


def test_collocations_of_odd_documents(odd_docs, no_docs, spark):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    more = [(None, "É é. A\tb  c,a b\x0bc A B C"), (None, "a b c"), ("de", "a b. a b. \U0001f600 漢 \U0001f600 漢 \U0001f600 漢"), ("de", "x")]
    docs = odd_docs.select("lang", "text", "doc_id").unionByName(
        spark.createDataFrame(more, "lang string, text string").withColumn("doc_id", F.lit(None).cast("long"))
    )
    want = plain_collocations(rows + more, 3, 2, 100)
    assert rows_of(collocations.collocations(docs, 3, 2, 100)) == ordered(want)
    assert {r[0] for r in want} >= {"en", "de", "und"}
    assert collocations.collocations(no_docs).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    """Counts near 10^10: the square times 10^6 needs 87 bits."""
    a, left, right = 9_876_543_211, 9_876_543_217, 12_345_678_901
    found = spark.createDataFrame(
        [("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", right), ("en", 0, "", 10**14)], "lang string, size int, phrase string, f long"
    )
    assert collocations.scored(found, 2).first()["score"] == 10**6 * a * a // (left * right)


# --- hard negatives ----------------------------------------------------------------------


def plain_negatives(rows, every=100):
    """Every score of every anchor, in Python's integers."""
    kept = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    anchors = {}
    for i, label, x in sorted(kept):
        if i % every == 0:
            anchors.setdefault(i, (label, x))
    out = []
    for i, (label, x) in anchors.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in kept if j != i)
        for p, j, _ in [s for s in scores if s[2]][:5]:
            fit = [(-s, k) for s, k, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r + 1, k, -p, s) for r, (s, k) in enumerate(fit)]
    return out


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("codes", [None, 1, 5])
def test_hard_negatives_equal_all_scores(spark, sf, monkeypatch, codes):
    """Small tiles, blocks and probes, so that the second round and its bounds decide."""
    for name, value in (("TILE", 16), ("BLOCK", 3), ("PROBE", 20)):
        monkeypatch.setattr(negatives, name, value)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_negatives([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()], 20)
    assert want and rows_of(negatives.hard_negatives(table, 20, codes=codes), *NEGATIVE) == ordered(want)


def test_hard_negatives_of_odd_rows(spark):
    rnd = random.Random(5)
    near = lambda k: [math.cos(k / 40), math.sin(k / 40), rnd.random() / 9]
    rows = [(i, near(i), i % 3) for i in range(0, 300, 3)] + [(i, near(i), i % 4) for i in range(1, 300, 5)]
    rows += [
        (None, [1.0, 0.0, 0.0], 1), (400, None, 1), (500, [1.0, None, 0.0], 1), (600, [float("nan"), 0.0, 0.0], 1),
        (601, [float("inf"), 0.0, 0.0], 1), (700, [1.0, 0.0, 0.0], None), (800, [], 2), (900, [0.5], 1), (1000, [-1.0] * 5, 0),
        (0, [1.0, 0.0, 0.0], 0), (0, [1.0, 0.0, 0.0], 0), (100, [0.9, 0.1, 0.0], 1), (3, [0.9, 0.1, 0.0], 1), (-100, [1.0, 0.2, 0.0], 0),
    ]
    rows += [(2000 + i, [1.0, 0.25, 0.0], i % 2) for i in range(200)]  # ties
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "'x' AS cell", "0 AS slot", "map(1, 2) AS vector").repartition(4)
    pad = lambda x: x if x is None else x + [0.0] * (5 - len(x))
    want = plain_negatives([(i, pad(x), label) for i, x, label in rows_of(table, "vec_id", "embedding", "label")])
    assert rows_of(negatives.hard_negatives(table), *NEGATIVE) == ordered(want)
    assert negatives.hard_negatives(table.limit(0)).count() == 0
    assert negatives.hard_negatives(table.filter("label IS NULL")).count() == 0


def test_hard_negatives_with_large_components(spark):
    """Products beyond 53 bits stay exact."""
    rows = [(100 * i, [float(2**22 + 3 * i), float(2**21 - 5 * i)], i % 2) for i in range(8)]
    table = spark.createDataFrame(rows, VECTORS)
    want = plain_negatives(rows)
    assert want and want[0][4] > 2**53
    assert rows_of(negatives.hard_negatives(table), *NEGATIVE) == ordered(want)


def test_bounds_hold_all_scores():
    """Each cell's bounds hold its scores, and cells come by falling bound."""
    rng = np.random.default_rng(3)
    rows, query = np.floor(rng.normal(0, 60, (400, 7))), np.floor(rng.normal(0, 60, 7))
    parts = negatives.halves(rows)
    books = tuple(negatives.codebook(p, 4) for p in parts)
    codes = [negatives.nearest(p, b) for p, b in zip(parts, books)]
    far = [np.sqrt(((p - b[c]) ** 2).sum(axis=1)) for p, b, c in zip(parts, books, codes)]
    cell = codes[0] * len(books[1]) + codes[1]
    cells = {int(c): (int((cell == c).sum()), float(far[0][cell == c].max()), float(far[1][cell == c].max())) for c in np.unique(cell)}
    seen = list(negatives.visits(query, books, cells))
    assert sorted(c for c, *_ in seen) == sorted(cells)
    assert [b for _, b, *_ in seen] == sorted((b for _, b, *_ in seen), reverse=True)
    for c, bound, upper, lower in seen:
        scores = rows[cell == c] @ query
        assert lower <= scores.min() and scores.max() <= upper <= bound + 1e-6


# --- language model ----------------------------------------------------------------------


class PlainTrie:
    """Contexts as tuples with a counter each; escapes and exclusions as one reads them."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        for text in texts:
            for context, symbol in self.steps(text):
                for d in range(order + 1):
                    self.counts.setdefault(context[order - d :], Counter())[symbol] += 1

    def steps(self, text):
        symbols = [*text, 256]
        run = [257] * self.order + symbols
        return [(tuple(run[i : i + self.order]), s) for i, s in enumerate(symbols)]

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for d in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - d :])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            below = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / below
            p *= len(left) / below if left else 1
            excluded |= set(left)
        return p / (257 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.probability(c, s)) for c, s in self.steps(text))


def plain_scores(docs, order=4):
    texts = [brute.lower(t).encode() for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    learnt = [t for t, h in zip(texts, held) if not h]
    trie, counts = PlainTrie(learnt, order), Counter(w for t in learnt for w in [*t.split(), None])
    total = sum(counts.values())
    out = []
    for (i, _), text, h in zip(docs, texts, held):
        tokens = [*text.split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        out.append((i, h, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, trie.score(text)))
    return out


SCORE = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def check_scores(df, want):
    got, want = rows_of(df, *SCORE), ordered(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want])


@pytest.mark.parametrize("part", [1 << 23, 2000])
def test_scores_equal_plain_ppm(real_docs, monkeypatch, part):
    """In one part and in many, held and handed on in small amounts."""
    for name, value in (("TOGETHER", 5000), ("HELD", 3000), ("HOT", 300)):
        monkeypatch.setattr(language_model, name, value)
    docs = real_docs.filter("doc_id < 40")
    check_scores(language_model.report(docs, part), plain_scores(pairs(docs)))


def test_scores_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 8")  # plain Python takes long on that one
    check_scores(language_model.report(docs), plain_scores(pairs(docs)))
    long = rows_of(language_model.report(odd_docs), *SCORE)
    assert len(long) == odd_docs.count() and all(math.isfinite(r[6]) for r in long)
    assert language_model.report(no_docs).count() == 0
    held = odd_docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    check_scores(language_model.report(held), plain_scores(pairs(held)))


def test_probabilities_of_all_symbols():
    """Over all symbols they add up to one, also in contexts never seen."""
    texts = [b"abracadabra", b"abra", b"", b"brabbel"]
    keys, n = np.unique(language_model.windows_of(texts)[0], return_counts=True)
    trie = language_model.Trie((keys, n), (keys, n))
    for context in (b"abra", b"zzzz", b"zzra", b"bbel", b"zzzl"):
        head = sum(c << (9 * (len(context) - k)) for k, c in enumerate(context))
        windows = np.array([head | s for s in range(257)])
        assert (10 ** trie.log10(windows)).sum() == pytest.approx(1)


def test_held_out_texts_are_foreseen(real_docs):
    """Contexts of four bytes tell more than none: held-out texts take fewer bits than bytes do alone."""
    docs = language_model.with_fold(real_docs)
    model = language_model.train(docs)
    held = [(t or "").encode().lower() for (t,) in docs.filter("held_out").select("text").collect()]
    learnt = Counter(b for (t,) in docs.filter("NOT held_out").select("text").collect() for b in [*(t or "").encode().lower(), 256])
    total = sum(learnt.values())
    alone = sum(math.log10((learnt[b] + 1) / (total + 257)) for t in held for b in [*t, 256])
    scores = language_model.scores(docs, model).filter("held_out").agg(F.sum("score")).first()[0]
    assert alone < scores * 1.5 < 0


def test_windows_come_in_parts():
    """The first two words stand together at the end of the key, and have one place."""
    windows = collocations.Windows(4)
    windows.add(["en"], pa.array(["a b c d. e"]))
    rows = [r for batch in windows.rows() for r in batch.to_pylist()]
    want = {"c d\ta b\ten", "d\tb c\ten", "\tc d\ten", "\td\ten", "\te\ten"}
    assert {(r["key"], r["f"]) for r in rows} == {(key, 1) for key in want}
    windows.add(["en"], pa.array(["x. a b x"]))
    places = {r["key"]: r["place"] for batch in windows.rows() for r in batch.to_pylist()}
    assert places["x\ta b\ten"] == next(r["place"] for r in rows if r["key"] == "c d\ta b\ten")
