"""Vectorised word splitting and hashing over Arrow string batches.

A word is a run of ``[0-9a-z]`` or non-ASCII characters after A-Z are
lower-cased, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. On UTF-8 that is a
statement about single bytes, so whole batches are split with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

#: Texts of about this many bytes are worked on together; a longer text is alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_GRAM = odd_constants(64, 7)
_SEEDS = odd_constants(64, 31)


def block_seeds(n: int) -> np.ndarray:
    """A constant for each of the first n blocks of eight bytes."""
    global _SEEDS
    if len(_SEEDS) < n:
        _SEEDS = odd_constants(2 * n, 31)
    return _SEEDS[:n]


def run_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits for each run of bytes; the runs of these lengths (none is 0) lie one behind the other in ``data``.

    Blocks of eight bytes are mixed with a constant of their place before they are
    added up, so that no structure of a long run (as of a word and its complement) cancels out.
    """
    if not len(length):
        return np.zeros(0, np.uint64)
    start = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(start, length)
    part = data.astype(np.uint64) << ((place & 7) << 3).astype(np.uint64)
    first = np.flatnonzero((place & 7) == 0)
    block = place[first] >> 3
    mixed = mix(np.add.reduceat(part, first) ^ block_seeds(int(block.max()) + 1)[block])
    total = np.add.reduceat(mixed, np.flatnonzero(block == 0))
    return mix(total + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``limit`` bytes; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = string_buffers(batch.column(column))
        ends, i = offsets[1:] - offsets[0], 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column, without copies of the bytes. Nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


class Words:
    """The words of a batch of texts as flat arrays.

    ``first[d]:first[d + 1]`` are the words of text d, ``hash`` has 64 bits for each
    word and ``lowered`` holds all words, each followed by a space, from ``at[i]`` on.
    """

    def __init__(self, array: pa.Array):
        offsets, raw = string_buffers(array)
        self.n_docs = len(offsets) - 1
        buf = LOWER[raw[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        mask = WORD_BYTE[buf]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        begins[inner] = mask[inner]
        starts = np.flatnonzero(begins)
        index = np.flatnonzero(mask)
        rank = np.searchsorted(index, starts)
        self.length = np.diff(np.append(rank, len(index)))
        self._buf, self.start = buf, starts
        self.first = np.searchsorted(starts, offsets)
        self.hash = run_hashes(buf[index], self.length)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def span(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by a space."""
        return b" ".join(self._buf[s : s + m].tobytes() for s, m in zip(self.start[i : i + n], self.length[i : i + n], strict=True))

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; the last n - 1 are missing."""
        return gram_hash(self.hash, n)

    def room(self, n: int) -> np.ndarray:
        """For each place of ``grams(n)``: do the n words belong to one text?"""
        ends = np.repeat(self.first[1:], self.counts)
        m = max(0, len(self) - n + 1)
        return np.arange(m) + n <= ends[:m]


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(words) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += words[j : j + m] * _GRAM[j % 64]
        if n > 1:
            out ^= out >> np.uint64(29)
    return mix(out)
