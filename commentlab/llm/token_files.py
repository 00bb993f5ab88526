"""Token ids in binary files: canonical length-limited Huffman codes over global id counts.

``encode`` tokenizes texts in ascending id order into segments of whole documents. ``write``
counts all ids, builds one code for the whole table and writes each segment as a bit string of
independent blocks, with the bit offset of every block as a checkpoint. ``read`` decodes all
blocks of a segment side by side through one table.

A written table has two folders: ``code`` (the code length of each id) and ``segments``.

Defined cases: a null text is empty; every document ends with ``END``, so none is without ids;
null ids come first; rows with one id are ordered by text; an empty table gives no segments and
an empty code; other columns are ignored. A document is never cut, a segment holds at least one.
"""

from __future__ import annotations

import gc
import os
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentlab.session import materialize, new_path

from .common import remembered, whole

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

END = 1
# Longest code in bits: the decoding table has 2**MAX_BITS entries.
MAX_BITS = 18
# Ids in a block; a segment is closed once it has SEGMENT ids.
BLOCK, SEGMENT = 256, 1 << 20
# Runs of text whose ids a worker remembers, the longest that it does, and texts looked at together.
REMEMBERED, LONGEST, TOGETHER = 600_000, 64, 256

Batches = Iterable[pa.RecordBatch]


class Chunks(dict):
    """Ids, as bytes, of runs without a space or line break. The tokenizer's pieces never reach
    across white space, so a text's ids are those of its runs one after another.

    A run that is a word and a full stop or comma has the ids of both, and those of a word are
    the same in either case of A-Z, so only new words are given to the tokenizer, many at once.
    A word that its normalizer leaves alone and its pattern takes whole skips both of them.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.any_text, self.whole_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole_words.normalizer = None
        self.whole_words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = kind

    def encode(self, tokenizer, texts: Iterable[str]) -> dict[str, bytes]:
        texts, kind = list(texts), self.kind
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {t: array(kind, e.ids).tobytes() for t, e in zip(texts, found)}

    def learn(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of runs that are not remembered; some are from now on."""
        parts, words, others = {}, set(), set()
        for run in runs:
            word, tail = (run[:-1], run[-1]) if run[-1:] in (".", ",") else (run, "")
            if word.isascii() and word.isalpha():
                word = word.lower()
            elif not word.isalpha() or unicodedata.normalize("NFC", word) != word or (low := ascii_lower(word)) != low.lower():
                others.add(run)
                continue
            else:
                word = low
            parts[run] = (word, tail)
            if word not in self:
                words.add(word)
            if tail and tail not in self:
                others.add(tail)
        new = self.encode(self.whole_words, words) | self.encode(self.any_text, others)
        for run, (word, tail) in parts.items():
            ids = new.get(word) or self[word]
            new[run] = ids + (new.get(tail) or self[tail]) if tail else ids
        if len(self) < REMEMBERED:
            self.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return new

    def texts(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text. Many small objects and no cycles are made: the collector would only search them."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.found(texts)
        finally:
            if collecting:
                gc.enable()

    def found(self, texts: Sequence[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = [list(map(self.get, runs)) for runs in split]
        gaps = [[i for i, ids in enumerate(found) if ids is None] for found in known]
        new = self.learn({runs[i] for runs, at in zip(split, gaps) for i in at})
        for runs, found, at in zip(split, known, gaps):
            for i in at:
                found[i] = new[runs[i]]
        return [b"".join(found) for found in known]


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def id_kind(path: str) -> str:
    """The narrowest unsigned type for the vocabulary's ids."""
    from tokenizers import Tokenizer

    return "H" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "I"


def segment_rows(path: str, kind: str, id_type: pa.DataType) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        chunks = remembered(f"{path} {kind}", lambda: Chunks(path, kind))
        part = TaskContext.get().partitionId()
        end, width = array(kind, [END]).tobytes(), np.dtype(kind).itemsize
        segment = first = 0
        docs, sizes, found, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([n], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([b"".join(found)], pa.binary()),
                ],
                ["part", "segment", "first", "n_ids", "doc_ids", "sizes", "ids"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                for doc, ids in zip(some.column("doc_id").to_pylist(), chunks.texts(some.column("text").to_pylist())):
                    docs.append(doc)
                    sizes.append(len(ids) // width + 1)
                    found += (ids, end)
                    n += sizes[-1]
                    if n >= SEGMENT:
                        yield close()
                        segment, first = segment + 1, first + n
                        docs, sizes, found, n = [], [], [], 0
        if docs:
            yield close()

    return rows


def encode(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """Segments ``part, segment, first, n_ids, doc_ids, sizes, ids`` in ascending id order, written,
    and the type of the ids. ``first`` counts the ids before the segment in its part."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = id_kind(tokenizer), docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", whole("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = (
        f"part int, segment int, first long, n_ids long, doc_ids array<{id_type.simpleString()}>, sizes array<long>, ids binary"
    )
    rows = ordered.mapInArrow(segment_rows(tokenizer, kind, to_arrow_type(id_type)), schema)
    return materialize(rows, "token-ids"), kind


def count_rows(kind: str) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                n = np.bincount(np.frombuffer(ids.as_py(), kind))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return rows


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by package-merge.

    Each round merges the sorted counts with sums of neighbours of the round before. The cheapest
    2n - 2 entries of the last round are chosen; the sums among them choose twice as many in the
    round before, and so on. A count's code is as long as the rounds that chose it.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves, sums, is_leaf = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, sums])
        place = np.argsort(both, kind="stable")
        is_leaf.append(place < n)
        both = both[place][: len(both) // 2 * 2]
        sums = both[::2] + both[1::2]
    bits, chosen = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:chosen].sum())
        bits[order[:own]] += 1
        chosen = 2 * (chosen - own)
    return bits


class Code:
    """A canonical code: shorter codes first, among equals by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(self.bits.max()) if len(ids) else 1
        spans = np.left_shift(1, self.longest - self.bits)
        self.starts = np.cumsum(spans) - spans  # codes, filled up to the longest

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit string of ``ids`` and, little-endian, the bit offset of each block."""
        size = int(self.ids.max()) + 1
        length, code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        length[self.ids] = self.bits
        code[self.ids] = self.starts >> (self.longest - self.bits)
        n_bits, codes = length[ids], code[ids]
        at = np.cumsum(n_bits) - n_bits
        word, room = at >> 6, 64 - (at & 63)
        over = n_bits - room  # bits that go on into the next word
        here = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        total = int(at[-1] + n_bits[-1])
        words = np.zeros((total + 63) // 64 + 1, np.uint64)
        # A code is shorter than a word, so some code starts in each word.
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        words[: len(firsts)] = np.bitwise_or.reduceat(here, firsts)
        cut = np.flatnonzero(over > 0)
        words[word[cut] + 1] |= codes[cut] << (64 - over[cut]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::BLOCK].astype("<u8").tobytes()

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next ``longest`` bits."""
        spans = np.left_shift(1, self.longest - self.bits)
        ids, bits = np.repeat(self.ids, spans), np.repeat(self.bits, spans)
        more = (1 << self.longest) - len(ids)  # a single id leaves values without a code
        return np.pad(ids, (0, more)).astype("<u4"), np.pad(bits, (0, more), constant_values=1)


def unpack(payload: bytes, checkpoints: bytes, n: int, longest: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a bit string: step k decodes the k-th id of every block at once."""
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, mask, last = np.frombuffer(checkpoints, "<u8").astype(np.int64), (1 << longest) - 1, len(windows) - 1
    out = np.empty((len(at), min(BLOCK, n)), "<u4")
    ids, bits = table
    for k in range(out.shape[1]):
        value = windows[np.minimum(at >> 3, last)] >> (32 - longest - (at & 7)).astype(np.uint32) & mask
        out[:, k] = ids[value]
        at = at + bits[value]
    return out.reshape(-1)[:n]


def packed_rows(kind: str, ids: np.ndarray, bits: np.ndarray) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        code = Code(ids, bits)
        for batch in batches:
            made = [code.pack(np.frombuffer(x.as_py(), kind)) for x in batch.column("ids")]
            kept = [batch.column(c) for c in ("part", "segment", "first", "n_ids", "doc_ids", "sizes")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))],
                ["part", "segment", "first", "n_ids", "doc_ids", "sizes", "payload", "checkpoints"],
            )

    return rows


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenize, count, encode and write ``docs`` (``doc_id, text``) below ``path``."""
    spark = docs.sparkSession
    segments, kind = encode(docs, tokenizer)
    counted = segments.select("ids").mapInArrow(count_rows(kind), "id long, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row per id of the vocabulary
    ids = counts["id"].to_numpy(np.int64)
    bits = code_lengths(counts["n"].to_numpy(np.int64))
    code = list(zip(ids.tolist(), bits.tolist()))
    spark.createDataFrame(code, "id long, bits long").coalesce(1).write.parquet(f"{path}/code")
    schema = segments.drop("ids").schema.add("payload", "binary").add("checkpoints", "binary")
    segments.mapInArrow(packed_rows(kind, ids, bits), schema).write.parquet(f"{path}/segments")


def document_rows(ids: np.ndarray, bits: np.ndarray, id_type: pa.DataType) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        code = Code(ids, bits)
        table = code.table()
        for batch in batches:
            for row in batch.to_pylist():
                found = unpack(row["payload"], row["checkpoints"], row["n_ids"], code.longest, table)
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                texts = [found[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], id_type), pa.array(starts + row["start"], pa.int64()), pa.array(texts, pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before) and ``ids`` (little-endian unsigned
    32-bit numbers) of every document of a written table."""
    from pyspark.sql.pandas.types import to_arrow_type

    segments = spark.read.parquet(f"{path}/segments")
    code = spark.read.parquet(f"{path}/code").toPandas()
    ids, bits = code["id"].to_numpy(np.int64), code["bits"].to_numpy(np.int64)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = segments.join(materialize(offsets, "offsets"), "part").withColumn("start", F.col("before") + F.col("first"))
    id_type = segments.schema["doc_ids"].dataType.elementType
    columns = placed.select("doc_ids", "sizes", "n_ids", "start", "payload", "checkpoints")
    return columns.mapInArrow(
        document_rows(ids, bits, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, start long, ids binary"
    )


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files and reads them back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
