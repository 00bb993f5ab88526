"""Token counts without tokens: Viterbi over a unigram vocabulary that keeps only counts.

An Aho-Corasick automaton of the vocabulary names every piece that ends at a place of the text.
Dynamic programming carries the best score and the number of pieces up to each place. Ties are
the tokenizer's: of equal scores the piece that starts first wins. A character that no piece
covers alone may stand as unknown, ten below the least score, and counts one per UTF-8 byte.

As in the tokenizer, a text begins with a space, and spaces are written as ``SPACE``. Where no
piece has a space after another character, best paths part before every run of spaces, and
each such stretch is counted once and remembered.

Defined cases: a null or empty text has 0 tokens; ids may be null or repeated, each row is counted
on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame

from .common import remembered

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Stretches of text whose counts a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64


class Counter(dict):
    """Number of pieces of a stretch of text, in the vocabulary of a sentencepiece file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.by_bytes = any(model.is_byte(i) for i in range(model.get_piece_size()))
        inner_space = any(SPACE in piece.lstrip(SPACE) for piece in scores)
        self.stretches = re.compile("(?s).+" if inner_space else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __missing__(self, stretch: str) -> int:
        n = self.pieces(stretch)
        if len(stretch) <= LONGEST:
            if len(self) < REMEMBERED:
                self[stretch] = n
        return n

    def pieces(self, text: str) -> int:
        """The pieces of the best path over ``text``."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, top, number, alone = 1, None, 0, False

        def close(at: int, top: float | None, number: int, alone: bool) -> None:
            if not alone:
                score = best[at - 1] + self.unknown
                if top is None or score > top:
                    top = score
                    number = count[at - 1] + (len(text[at - 1].encode()) if self.by_bytes else 1)
            best[at], count[at] = top, number

        # Matches come by their end, among those with one end the longest first.
        for end, (length, score) in self.automaton.iter(text):
            while at <= end:
                close(at, top, number, alone)
                at, top, number, alone = at + 1, None, 0, False
            start = at - length
            score += best[start]
            if top is None or score > top:
                top, number = score, count[start] + 1
            alone = alone or length == 1
        while at <= n:
            close(at, top, number, alone)
            at, top, number, alone = at + 1, None, 0, False
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.stretches.findall(SPACE + text.replace(" ", SPACE))))


def count_rows(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = remembered(f"counts {path}", lambda: Counter(path))
        for batch in batches:
            counts = [counter.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return rows


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document row: ``doc_id, n_tokens``. ``vocabulary`` names a file every executor has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count_rows(vocabulary), f"doc_id {kind}, n_tokens long")
