"""Token counts of a unigram tokenizer, without building the tokens.

The words of a text (a space in front, unless it begins with one; each space
begins a word, U+2581 and the other characters up to the next space) are segmented for the best sum of piece scores. An Aho-Corasick automaton enumerates
the vocabulary's matches in a word; dynamic programming carries, for each place,
the best score and its number of pieces. Ties go as in the tokenizer: of equal
scores the longest last piece wins. A character that is no piece counts as
unknown, ten below the lowest score, and as its UTF-8 bytes, or as one token for a run of such
characters if the vocabulary has no byte pieces. Each distinct word of a batch is looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_bpe import NORMAL, SPACE, BpeModel
from .spark import map_arrow
from .text import text_chunks

UNKNOWN_PENALTY = 10.0
MEMORY_WORDS = 200_000


def vocabulary(model: BpeModel) -> list[tuple[str, float]]:
    """Pieces of a model file with the log probability that Zipf's law gives to their rank."""
    pieces = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, -math.log(i + 1) - total) for i, p in enumerate(pieces)]


class Counter:
    """Counts pieces of words; remembers up to ``MEMORY_WORDS`` of them."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, count, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            matches[end].append(piece)
        for end in range(1, n + 1):
            top, single = None, False
            for size, score in matches[end - 1]:  # longest first
                single |= size == 1
                s = score + best[end - size]
                if top is None or s > top:
                    top, count[end], unknown[end] = s, count[end - size] + 1, False
            if not single:
                s = self.unknown + best[end - 1]
                if top is None or s > top:
                    size = len(word[end - 1].encode()) if self.byte_fallback else int(not unknown[end - 1])
                    top, count[end], unknown[end] = s, count[end - 1] + size, True
            best[end] = top
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        total, known = 0, self.known
        text = text.replace(SPACE, " ")
        for w in (text if text[0] == " " else " " + text).split(" ")[1:]:
            n = known.get(w)
            if n is None:
                if len(known) >= MEMORY_WORDS:
                    known.clear()
                n = known[w] = self.word(SPACE + w)
            total += n
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], *, doc_id: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """A row for each row of docs: ``doc_id, n_tokens``. Null and empty texts have 0 tokens; other columns are ignored.

    Of segmentations with equal scores the tokenizer's own is counted. Repeated rows stay, texts of any length are counted whole, an empty table gives no row.
    """
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces, byte_fallback)
        for chunk in text_chunks(batches, "text"):
            n = np.array([counter.text(t) for t in chunk.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column("_id"), pa.array(n)], names=["_id", "n_tokens"])

    return map_arrow(source, run, f"_id {kind}, n_tokens long").withColumnRenamed("_id", doc_id)
