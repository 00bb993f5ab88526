"""Language-model scores by prediction by partial matching (PPM), beside a unigram base.

The trie of byte contexts is learnt from all training texts: every byte, and the end of each text,
counts once with the ``ORDER`` symbols before it (``START`` stands before a text). Contexts of every
shorter length are sums of these windows, so the trie is one sorted array per length. A symbol is
coded in the longest known context that has it. Each context on the way down escapes by method C
(the number of its symbols over all counts and symbols), and symbols seen in a longer context are
excluded from the shorter ones. A text's score is the log10 probability of its bytes and its end.

The windows are counted by Spark. They go to the workers in parts of about ``PART`` windows, by the
last two symbols of the context; below one such pair lie at most 257 ** (ORDER - 1) windows, whatever the
corpus. Each part is one pass over the texts that scores the symbols it knows all about; the
driver holds one part at a time. Words of the unigram base are counted over everything: those that make
up ``1 / HOT`` of all words (so ``HOT`` at most) are looked up by the workers, the rest in a join.

Defined cases: a null text is empty and has one token, its end; a null id is taken as empty text and so
is not held out; repeated rows are learnt from and scored each; without training texts every word is
unknown and all symbols are alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.keyed import union_all
from commentlab.session import materialize

from .common import remembered, same, text_key

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

ORDER = 4  # bytes of the longest context
BITS = 9  # of a symbol
END, START = 256, 257
SYMBOLS = 257  # bytes and the end
BRANCH = 2  # symbols at a context's end by which the trie is dealt to parts
PART = 1 << 23  # windows of a part, about
HOT = 100_000  # words that may be sent to the workers
LONGEST = 256  # bytes of such a word
# Bytes of text scored or counted at a time, and windows or words held before they are handed on.
TOGETHER, HELD = 1 << 19, 1 << 19
FOLDS, OUT = 5, 1  # documents with this remainder are held out


def mask(symbols: int) -> np.int64:
    return np.int64((1 << (BITS * symbols)) - 1)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts the window that ends with it, and the number of its text."""
    before = np.full(ORDER, START, np.int64)
    runs, sizes = [], []
    for text in texts:
        runs += [before, np.frombuffer(text, np.uint8).astype(np.int64), np.array([END], np.int64)]
        sizes.append(len(text) + 1)
    symbols = np.concatenate(runs) if runs else np.empty(0, np.int64)
    window = np.zeros(len(symbols), np.int64)
    for k in range(ORDER, -1, -1):
        window <<= BITS
        window[k:] |= symbols[: len(symbols) - k]
    own = np.repeat(np.arange(len(texts)), sizes)
    return window[np.arange(len(own)) + ORDER * (own + 1)], own


def some_texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about ``TOGETHER`` bytes, with A-Z in lower case."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes) // TOGETHER
    for rows in np.split(np.arange(batch.num_rows), np.nonzero(np.diff(ends))[0] + 1):
        if len(rows):
            some = batch.slice(int(rows[0]), len(rows))
            yield some, [(t or "").encode().lower() for t in some.column("text").to_pylist()]
    # Workers stay for later stages; what they no longer use goes back.
    pa.default_memory_pool().release_unused()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.diff(keys, prepend=keys[:1] - 1))[0] if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows counted within the task: ``window, n``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def row_batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["window", "n"])

    for batch in batches:
        for _, texts in some_texts(batch):
            coded = pa.array(windows_of(texts)[0]).dictionary_encode()
            held.append((coded.dictionary.to_numpy(), np.bincount(coded.indices.to_numpy())))
            if sum(len(k) for k, _ in held) > HELD:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield row_batch(*held.pop())
    if held:
        yield row_batch(*summed(*(np.concatenate(x) for x in zip(*held))))


def word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words counted within the task: ``word, held_out, n``."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def row_batches() -> Iterator[pa.RecordBatch]:
        for out, c in counts.items():
            if c:
                columns = [pa.array(list(c), pa.binary()).cast(pa.string()), pa.repeat(out, len(c)), pa.array(list(c.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "held_out", "n"])
            c.clear()

    for batch in batches:
        for rows, texts in some_texts(batch):
            for out, text in zip(rows.column("held_out").to_pylist(), texts):
                counts[out].update(text.split())
            if len(counts[True]) + len(counts[False]) > HELD // 2:
                yield from row_batches()
    yield from row_batches()


class Trie:
    """Counts of contexts and symbols, one level per length of context.

    ``base`` has the windows of one symbol before the last over the whole corpus (``window, n``);
    ``windows`` are those of this part of the trie.
    """

    def __init__(self, windows: tuple[np.ndarray, np.ndarray], base: tuple[np.ndarray, np.ndarray]) -> None:
        self.levels: list[dict[str, np.ndarray]] = []
        for d in range(ORDER + 1):
            keys, counts = base if d < BRANCH else windows
            keys, n = summed(keys & mask(d + 1), counts)
            contexts, first = np.unique(keys >> BITS, return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(keys)))
            level = {"keys": keys, "n": n, "contexts": contexts, "below": total + kinds, "escape": kinds}
            if d:
                # What the next shorter context has left once the symbols of this one are excluded.
                above = self.levels[-1]
                taken = above["n"][np.searchsorted(above["keys"], keys & mask(d))]
                parent = np.searchsorted(above["contexts"], contexts & mask(d - 1))
                rest = above["escape"][parent] - kinds
                excluded = np.add.reduceat(taken, first) if len(first) else taken
                level |= {"next_escape": rest, "next_below": above["below"][parent] - above["escape"][parent] - excluded + rest}
            self.levels.append(level)

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """The log10 probability of the last symbol of each window after the others."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        below, escape = np.full(len(windows), -1), np.full(len(windows), -1)
        for d in range(ORDER, -1, -1):
            level, w = self.levels[d], windows[left]
            at, known = found(level["contexts"], (w >> BITS) & mask(d))
            if not known.any():
                continue
            fresh = known & (below[left] < 0)
            below[left[fresh]], escape[left[fresh]] = level["below"][at[fresh]], level["escape"][at[fresh]]
            place, coded = found(level["keys"], w & mask(d + 1))
            hit = left[coded]
            out[hit] += np.log10(level["n"][place[coded]] / below[hit])
            down = known & ~coded
            miss = left[down]
            some = miss[escape[miss] > 0]
            out[some] += np.log10(escape[some] / below[some])
            if d:
                below[miss], escape[miss] = level["next_below"][at[down]], level["next_escape"][at[down]]
            left = left[~coded]
        out[left] -= math.log10(SYMBOLS - len(self.levels[0]["keys"])) if len(left) else 0
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and which of the wanted are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def branch_of(windows: np.ndarray) -> np.ndarray:
    return (windows >> BITS) & mask(BRANCH)


def part_of(branch: np.ndarray, parts: int) -> np.ndarray:
    return branch * 2654435761 % (1 << 32) % parts


@dataclass(frozen=True)
class Part:
    """One part of the trie on its way to the workers."""

    name: str
    arrays: Broadcast
    number: int
    parts: int

    def trie(self) -> Trie:
        """Built once in a worker; it takes the place of the part before."""
        memo = remembered("ppm", dict)
        if self.name not in memo:
            memo.clear()
            memo[self.name] = Trie(*self.arrays.value)
        return memo[self.name]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Per text the sum over the symbols whose context lies in this part."""
        windows, own = windows_of(texts)
        if self.parts > 1:
            kept = part_of(branch_of(windows), self.parts) == self.number
            windows, own = windows[kept], own[kept]
        coded = pa.array(windows).dictionary_encode()
        each = self.trie().log10(coded.dictionary.to_numpy())
        return np.bincount(own, each[coded.indices.to_numpy()], len(texts))


@dataclass(frozen=True)
class Model:
    """``windows`` (``window, n``), ``words`` (``word, n_train, n_all``), and the sums of both."""

    windows: DataFrame
    words: DataFrame
    parts: int
    tokens: int  # of the training texts, their ends included
    kinds: int  # of these tokens
    texts: int  # for training
    words_in_all: int

    def part(self, number: int) -> Part:
        """Collects and sends out one part of the trie."""
        spark = self.windows.sparkSession
        branch = F.expr(f"(window >> {BITS}) & {int(mask(BRANCH))}L")
        here = self.windows.filter(part_column(branch, self.parts) == number) if self.parts > 1 else self.windows
        base = self.windows.groupBy(F.expr(f"window & {int(mask(BRANCH))}L").alias("window")).agg(F.sum("n").alias("n"))
        tables = [t.select("window", "n").toArrow() for t in (here, base)]
        arrays = tuple(tuple(t.column(c).to_numpy() for c in ("window", "n")) for t in tables)
        return Part(uuid.uuid4().hex, spark.sparkContext.broadcast(arrays), number, self.parts)

    def log10(self, count: int) -> float:
        """Of a token of the base that was seen ``count`` times in training."""
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def frequent(self) -> dict[bytes, int]:
        """Training counts of the words that make up ``1 / HOT`` of all, ``HOT`` of them at most."""
        often = self.words.filter((F.col("n_all") * HOT >= self.words_in_all) & (F.octet_length("word") <= LONGEST))
        table = often.select("word", "n_train").toArrow()
        return dict(zip(map(str.encode, table.column("word").to_pylist()), table.column("n_train").to_pylist()))


def part_column(branch: Column, parts: int) -> Column:
    return F.pmod(F.pmod(branch * 2654435761, F.lit(1 << 32)), F.lit(parts))


def with_fold(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "text", (F.pmod(fold, F.lit(FOLDS)) == OUT).alias("held_out"))


def train(docs: DataFrame, part: int = PART) -> Model:
    """From ``doc_id, text, held_out``: learns from all rows that are not held out."""
    learnt = docs.filter("NOT held_out")
    windows = learnt.select("text").mapInArrow(window_batches, "window long, n long")
    windows = materialize(windows.groupBy("window").agg(F.sum("n").alias("n")), "windows")
    words = docs.select("held_out", "text").mapInArrow(word_batches, "word string, held_out boolean, n long")
    own = F.when(F.col("held_out"), 0).otherwise(F.col("n"))
    words = materialize(words.groupBy("word").agg(F.sum(own).alias("n_train"), F.sum("n").alias("n_all")), "words")
    texts = learnt.count()
    sums = words.agg(F.sum("n_train").alias("n"), F.count_if(F.col("n_train") > 0).alias("kinds"), F.sum("n_all").alias("all")).first()
    return Model(
        windows, words, max(1, math.ceil(windows.count() / part)), (sums["n"] or 0) + texts,
        sums["kinds"] + (texts > 0), texts, sums["all"] or 0,
    )


def scored(model: Model, frequent: Broadcast, part: Part) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the part's score, the base's over the end and the frequent words, and the other words."""
    log10, texts_learnt = [model.log10(0), model.log10(model.texts)], model.texts
    tokens, kinds = model.tokens, model.kinds
    columns = ["doc_id", "text_key", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "counts"]

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = frequent.value
        below = tokens + 0.5 * (kinds + 1)
        for batch in parts:
            for rows, texts in some_texts(batch):
                made: list[list] = [[], [], [], [], []]
                for text in texts:
                    n_tokens, known, base, rest = 1, int(texts_learnt > 0), log10[1], {}
                    for word, n in Counter(text.split()).items():
                        n_tokens += n
                        if (seen := counts_of.get(word)) is None:
                            rest[word] = n
                        else:
                            base += n * math.log10((seen + 0.5) / below)
                            known += n if seen else 0
                    for to, x in zip(made, (n_tokens, known, base, list(rest), list(rest.values()))):
                        to.append(x)
                kept = [rows.column(c) for c in columns[:3]]
                sums = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())]
                lists = [pa.array(made[3], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(made[4], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *sums, pa.array(part.scores(texts)), *lists], columns)

    return batches


def more_scores(part: Part) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for rows, texts in some_texts(batch):
                kept = [rows.column("doc_id"), rows.column("text_key")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(part.scores(texts))], ["doc_id", "text_key", "score"])

    return batches


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``doc_id, text, held_out``: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key().alias("text_key"), "held_out", "text")
    frequent = spark.sparkContext.broadcast(model.frequent())
    first = keyed.mapInArrow(
        scored(model, frequent, model.part(0)),
        f"doc_id {kind}, text_key long, held_out boolean, n_tokens long, n_known long, base_score double, "
        "score double, words array<string>, counts array<long>",
    )
    # The numbers are written with the rows, so they stay what they are.
    rows = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.inline(F.arrays_zip("words", "counts"))).toDF("row", "word", "times")
    rare = rare.join(model.words.select("word", "n_train"), "word")
    base = F.log10((F.col("n_train") + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * base).alias("rare_score"), F.sum(F.when(F.col("n_train") > 0, F.col("times"))).alias("rare_known")
    )
    out = rows.drop("words", "counts").join(sums, "row", "left")
    more = F.lit(0.0)
    if model.parts > 1:
        # Rows alike in id and text share one result.
        each = [keyed.mapInArrow(more_scores(model.part(k)), f"doc_id {kind}, text_key long, score double") for k in range(1, model.parts)]
        each = [e.groupBy("doc_id", "text_key").agg(F.max("score").alias("more")) for e in each]
        rest = materialize(union_all(each).groupBy("doc_id", "text_key").agg(F.sum("more").alias("more")), "more-scores")
        out = out.join(rest, same(out, rest, ["doc_id", "text_key"]), "left").select(out["*"], "more")
        more = F.col("more")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("rare_score")).alias("base_score"), (F.col("score") + zero(more)).alias("score"),
    )


def report(docs: DataFrame, part: int = PART) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    rows = with_fold(docs)
    return scores(rows, train(rows, part))
