"""Phrase collocations from vertical positional lists.

The corpus is a line of word positions; a phrase is the sorted list of positions at which
it begins, and the list's length is its frequency. Lists grow level by level: the
occurrences p of frequent phrases of k words are merge-joined with the postings of
their neighbours: a phrase of k + 1 words begins where p and p + 1 are both in lists of
frequent phrases of k words, in one piece of text. A task does this
for its documents (no phrase crosses them); lengths are added up by phrase.

A level is one pass over the texts. Which phrases of the level before are frequent goes to the tasks as a
Bloom filter of at most ``FILTER_BITS`` bits. It only saves work: what it lets through by
mistake is too rare to make a longer phrase frequent, and at the next pass the frequencies
of all that passed are counted by their texts, not by hashes. So the frequencies are exact at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import FILTER_BITS, LEAST_BITS, filter_bits, passing
from .spark import cut, cut_seen, map_arrow
from .text import LOWER, block_seeds, mix, run_hashes, string_buffers, text_chunks

LEAST, LONGEST, TOP, COVERED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Bytes of text that are worked on together, and distinct keys and phrases that a task adds up before it hands them on.
CHUNK, HELD, TEXTS = 2 << 20, 1 << 20, 1 << 17
#: Bits of a key that leave a task: phrases that share one are only let through the filter together.
KEY_BITS = 48
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _STOP.copy()
_BREAK[[ord(" "), ord("\t")]] = True


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits for each word, from eight bytes at a time; ``data`` has eight bytes to spare at its end."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = length.astype(np.uint64) * _GOLDEN
    at, done = np.arange(len(start)), 0
    while len(at) and done < 256:
        left = length[at] - done
        part = eight[start[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(0, 8 - left).astype(np.uint64)))
        out[at] = mix(out[at] ^ mix(part ^ block_seeds(done // 8 + 1)[done // 8]))
        at, done = at[left > 8], done + 8
    if len(at):  # very long words
        own = np.concatenate([data[s : s + n] for s, n in zip(start[at].tolist(), length[at].tolist(), strict=True)])
        out[at] = run_hashes(own, length[at])
    return out


class Postings:
    """The words of a chunk of texts: ``key`` for each position, and whether the next word is in the same piece."""

    def __init__(self, chunk: pa.RecordBatch):
        offsets, raw = string_buffers(chunk.column("text"))
        self.data = np.concatenate([LOWER[raw[offsets[0] : offsets[-1]]], np.zeros(8, np.uint8)])
        offsets, size = offsets - offsets[0], int(offsets[-1] - offsets[0])
        word = ~_BREAK[self.data[:size]]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < size)]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)
        stop = np.flatnonzero(_STOP[self.data[:size]])
        piece = np.searchsorted(stop, self.start)
        self.joined = piece[1:] == piece[:-1]
        edge = self.first[(self.first > 0) & (self.first < len(self.start))]
        self.joined[edge - 1] = False
        names = chunk.column("lang").dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = np.repeat(names.indices.to_numpy().astype(np.int32), np.diff(self.first))
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.key = mix(word_hashes(self.data, self.start, self.length) + salt[self.lang]) if len(self.start) else np.zeros(0, np.uint64)

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.data[s : s + n].tobytes() for s, n in zip(self.start[at : at + k].tolist(), self.length[at : at + k].tolist(), strict=True)).decode()


def extend(postings: Postings, at: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions and keys of phrases of k + 1 words, from those (sorted) of frequent ones of k."""
    both = np.diff(at) == 1
    if k == 1:
        both &= postings.joined[at[:-1]]
    both = np.flatnonzero(both)
    return at[both], mix(key[both] * _GOLDEN + postings.key[at[both] + k])


def lists(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the lengths of their lists, and a place in ``key`` of each."""
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    return key[order[new]], np.diff(np.append(new, len(key))), order[new]


def _short(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(64 - KEY_BITS)


class _Sums:
    """Lengths of lists added up by key, with the phrase's language and text or without."""

    def __init__(self):
        self.keys, self.counts, self.held, self.text = [], [], 0, {}

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)

    def full(self) -> bool:
        """Are there more than ``HELD`` distinct keys, or texts enough? Looked at when twice as many are held."""
        if self.held > 2 * HELD:
            keys, counts = self.take()
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
            return self.held > HELD
        return len(self.text) > TEXTS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts, self.held = [], [], 0
        return keys[order[new]], np.add.reduceat(counts[order], new) if len(new) else np.zeros(0, np.int64)

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.take()
        for i in range(0, len(keys), 1 << 16):
            k, c = keys[i : i + (1 << 16)], pa.array(counts[i : i + (1 << 16)].astype(np.int64))
            if self.text:
                said = [self.text[x] for x in k.tolist()]
                yield _batch(pa.nulls(len(k), pa.int64()), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.string()), c)
            else:
                yield _batch(pa.array(k.view(np.int64)), pa.nulls(len(k), pa.string()), pa.nulls(len(k), pa.string()), c)
        self.text = {}


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["key", "lang", "phrase", "c"])


def _level(k: int, filters: list[np.ndarray], longest: int):
    """The pass that counts the frequent phrases of k words by their texts, and those of k + 1 words by their keys (the longest by texts, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, hashed, words = _Sums(), _Sums(), {}

        def by_text(p: Postings, at: np.ndarray, key: np.ndarray, size: int) -> None:
            keys, lengths, where = lists(key)
            for x, i in zip(keys.tolist(), at[where].tolist(), strict=True):
                if x not in said.text:
                    said.text[x] = (p.langs[p.lang[i]], p.phrase(i, size))
            said.add(keys, lengths)

        for chunk in text_chunks(batches, "text", CHUNK):
            p = Postings(chunk)
            at, key = np.arange(len(p.key)), p.key
            for j, packed in enumerate(filters, 1):
                if j > 1:
                    at, key = extend(p, at, key, j - 1)
                live = passing(packed, _short(key))
                live.sort()
                at, key = at[live], key[live]
            if k:
                by_text(p, at, key, k)
                at, key = extend(p, at, key, k)
            else:
                for x, c in zip(p.langs, np.bincount(p.lang, minlength=len(p.langs)).tolist(), strict=True):
                    words[x] = words.get(x, 0) + c
            if k and k + 1 == longest:
                by_text(p, at, key, k + 1)
            else:
                hashed.add(*lists(_short(key))[:2])
            for sums in (said, hashed):
                if sums.full():
                    yield from sums.batches()
        yield from said.batches()
        yield from hashed.batches()
        if words:
            yield _batch(pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()), pa.array(list(words.values()), pa.int64()))

    return run


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(filter_bits(batch.column("key").to_numpy().view(np.uint64), bits))
            if len(bit):
                first = np.flatnonzero(np.concatenate([[True], np.diff(bit >> 6) > 0]))
                yield pa.RecordBatch.from_arrays([pa.array(bit[first] >> 6), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first).view(np.int64))], names=["place", "held"])

    return run


def _filter(keys: DataFrame, n: int, limit: int) -> np.ndarray:
    """A filter of these n keys (8 bits each, within the limits): at most one row for each 64 bits comes to the driver."""
    bits = LEAST_BITS
    while bits < min(limit, 8 * n):
        bits *= 2
    words = np.zeros(bits // 64, np.int64)
    got = map_arrow(keys, _bits(bits), "place long, held long").groupBy("place").agg(F.bit_or("held").alias("held")).toArrow()
    words[got.column("place").to_numpy()] = got.column("held").to_numpy()
    return words.view(np.uint8)


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, filter_limit: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``longest`` words with f >= ``least``, and (lang, n) with all words."""
    source = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    filters: list[np.ndarray] = []
    found, totals = [], None
    for k in range(longest):
        counted = map_arrow(source, _level(k, filters, longest), "key long, lang string, phrase string, c long").groupBy("key", "lang", "phrase").agg(F.sum("c").alias("f"))
        by_key = F.col("key").isNotNull()
        level, seen = cut_seen(counted.where((F.col("f") >= least) | (~by_key & F.col("phrase").isNull())), F.count_if(by_key).alias("keys"))
        if k == 0:
            totals = level.where(~by_key).select("lang", F.col("f").alias("n"))
        else:
            found.append(level.where(~by_key).select("lang", "phrase", "f"))
        if k + 1 < longest:
            filters.append(_filter(level.where(by_key).select("key"), seen["keys"], filter_limit))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, totals


def _words(w: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, scale: int = SCALE, filter_limit: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` phrases of two words and more of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is a run of words (anything between spaces and tabs, A-Z lower-cased) inside a piece
    (between ``. , ; : ! ?`` and line ends). a is its frequency, l and r those of the two
    parts it is cut into, score floor(scale * a / (l + r)), of the cut where that is
    lowest (of equal ones the first). A phrase inside a longer one with at
    least ``covered`` percent of its frequency is left out. n counts the words of the
    language. Order: score and a falling, then the phrase by its bytes.

    Null texts are empty, a null language is ``und``; repeated rows count as often
    as they occur; an empty table gives no row; a very long text is worked on alone. Other columns are ignored.
    In one task, equal 64-bit keys are taken as equal phrases.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    found, totals = frequent_phrases(docs, text=text, lang=lang, least=least, longest=longest, filter_limit=filter_limit)
    found = found.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    candidates = found.where("k > 1")
    parts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = parts.select("lang", "phrase", "a", "cut", _words(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _words(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    known = found.select("lang", "phrase", "f")
    parts = parts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    parts = parts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"cast((cast({scale} as decimal(15,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as bigint)")
    lowest = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "cut")).alias("s")).select("lang", "phrase", "s.*")
    inner = candidates.where("k > 2").select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    around = inner.groupBy("lang", _words(F.col("w"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    free = lowest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    # The first of each of 64 shares before the first of all: no task has all phrases of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    free = free.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = free.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
