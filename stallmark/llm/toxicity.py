"""Toxicity scores from a convolutional text classifier in numpy.

A word is the sum of the hashed embeddings of itself and of two of its prefixes.
Filters over one, two and three words are pooled by their maximum over the whole text and
feed a logistic layer. Training (Adagrad; only the places of the maxima get
gradients) goes over all labelled texts, whole: tasks train on shards and their changes are averaged
after each pass. A threshold for each language, told from the text alone, is calibrated on every
fifth of them, all of which are held back; scores are shifted so that it lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language, training
from .spark import map_arrow, with_text
from .text import Words, mix, text_chunks

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
PREFIXES = (4, 6)
#: Passes over all texts: so many texts are seen in all, and each at least twice.
TEXTS_SEEN, MIN_PASSES, MAX_PASSES = 12_000, 2, 40
#: Steps of a logit by which thresholds are counted.
GRID = 256
#: Words that are convolved at once.
BLOCK = 1 << 15
BATCH_WORDS = 30_000
#: Bytes of text that are worked on together.
CHUNK_BYTES = 1 << 19
_TAPS = [(k, j) for k in WIDTHS for j in range(k)]


def word_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words as rows of buckets, and the row of each word."""
    _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    columns = [words.hash[at]]
    for n in PREFIXES:
        part = np.full(len(at), n, np.uint64)
        for j in range(n):
            inside = words.length[at] > j
            byte = words._buf[np.minimum(words.start[at] + j, max(len(words._buf) - 1, 0))].astype(np.uint64) + np.uint64(1)
            part = part * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, byte, np.uint64(0))
        columns.append(mix(part))
    return (np.stack(columns, 1) & np.uint64(BUCKETS - 1)).astype(np.int64).reshape(-1, 1 + len(PREFIXES)), back.reshape(-1)


class ToxicityModel:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.E = (rng.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.W = {t: (rng.normal(size=(DIM, FILTERS)) * 0.25).astype(np.float32) for t in _TAPS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = (rng.normal(size=FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.languages: language.LanguageModel | None = None
        self.threshold, self.slope = {-1: 0.0}, 1.0

    def pooled(self, words: Words) -> np.ndarray:
        """The maxima (texts x filters), at least 0, over whole texts, block by block."""
        out = np.zeros((words.n_docs, FILTERS * len(WIDTHS)), np.float32)
        if not len(words):
            return out
        rows, back = word_buckets(words)
        weights = np.concatenate([self.W[t] for t in _TAPS], 1)
        table = self.E[rows].sum(1) @ weights
        ends = np.repeat(words.first[1:], words.counts)
        owner = np.repeat(np.arange(words.n_docs), words.counts)
        for lo in range(0, len(words), BLOCK):
            hi = min(lo + BLOCK, len(words))
            top = min(hi + max(WIDTHS) - 1, len(words))
            taps = table[back[lo:top]]
            size = hi - lo
            starts = np.flatnonzero(np.concatenate([[True], owner[lo + 1 : hi] != owner[lo : hi - 1]]))
            for i, k in enumerate(WIDTHS):
                h = np.repeat(self.b[k][None], size, 0)
                room = ends[lo:hi] - np.arange(lo, hi)
                for j in range(k):
                    t = _TAPS.index((k, j)) * FILTERS
                    part = taps[j : j + size, t : t + FILTERS]
                    if j:
                        h[: len(part)] += np.where((room > j)[: len(part), None], part, 0)
                    else:
                        h += part
                best = np.maximum.reduceat(h, starts, axis=0)
                at = out[owner[lo:hi][starts], i * FILTERS : (i + 1) * FILTERS]
                out[owner[lo:hi][starts], i * FILTERS : (i + 1) * FILTERS] = np.maximum(at, best)
        return out

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words).astype(np.float64) @ self.v + float(self.c[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        z = self.logits(words)
        lang = self.languages.predict(texts.to_pylist()) if self.languages is not None and self.languages.languages else np.full(len(z), -1)
        z = z - np.array([self.threshold.get(int(i), self.threshold[-1]) for i in lang])
        return 1 / (1 + np.exp(-np.clip(self.slope * z, -500, 500)))


def _step(model: ToxicityModel, seen: dict, rows: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One mini-batch; ``rows`` are bucket rows of the distinct words, each text is an array of them, padded by the last (empty) row."""
    pad = len(rows)
    flat = np.concatenate([np.concatenate([t, np.full(max(WIDTHS), pad)]) for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) + max(WIDTHS) for t in texts])])
    used, back = np.unique(flat, return_inverse=True)
    some = np.zeros((len(used), DIM), np.float32)
    some[used != pad] = model.E[rows[used[used != pad]]].sum(1)
    taps = (some @ np.concatenate([model.W[t] for t in _TAPS], 1))[back]
    n, pooled, places = len(texts), [], []
    for k in WIDTHS:
        h = np.repeat(model.b[k][None], len(flat), 0)
        for j in range(k):
            t = _TAPS.index((k, j)) * FILTERS
            h[: len(flat) - j] += taps[j:, t : t + FILTERS]
        at = np.stack([first[d] + h[first[d] : max(first[d] + 1, first[d] + len(texts[d]))].argmax(0) for d in range(n)])
        places.append(at)
        pooled.append(np.take_along_axis(h, at, 0))
    m = np.concatenate(pooled, 1)
    live = np.maximum(m, 0)
    p = 1 / (1 + np.exp(-np.clip(live @ model.v + model.c, -60, 60)))
    g = ((p - y) * weight / n).astype(np.float32)
    dm = (g[:, None] * model.v[None]) * (m > 0)

    def update(name: object, value: np.ndarray, grad: np.ndarray, lr: float = rate) -> None:
        s = seen.setdefault(name, np.full_like(value, 1e-6))
        s += grad * grad
        value -= lr * grad / np.sqrt(s)

    dv, touched, grads = live.T @ g, [], []
    for i, k in enumerate(WIDTHS):
        d = dm[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(k):
            at = places[i] + j
            update((k, j), model.W[k, j], np.matmul(some[back[at]].transpose(1, 2, 0), d.T[:, :, None])[:, :, 0].T)
            touched.append(flat[at].reshape(-1))
            grads.append((d[:, :, None] * model.W[k, j].T[None]).reshape(-1, DIM))
        update(k, model.b[k], d.sum(0))
    update("v", model.v, dv)
    update("c", model.c, g.sum(keepdims=True))
    at, grad = np.concatenate(touched), np.concatenate(grads)
    good = (at != pad) & (np.abs(grad).sum(1) > 0)
    if good.any():
        bucket = rows[at[good]]
        u, inv = np.unique(bucket.reshape(-1), return_inverse=True)
        total = np.zeros((len(u), DIM), np.float32)
        np.add.at(total, inv.reshape(-1), np.repeat(grad[good], bucket.shape[1], 0))
        s = seen.setdefault("E", np.full((BUCKETS, DIM), 1e-6, np.float32))
        s[u] += total * total
        model.E[u] -= rate * total / np.sqrt(s[u])


def _pieces(texts: list[str]) -> Iterator[pa.Array]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    return (c.column("t") for c in text_chunks(iter([batch]), "t", CHUNK_BYTES))


def _word_rows(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bucket rows of all distinct words, and each text as row numbers; piece by piece, as the arrays of a text are many times its size."""
    hashes, buckets, split, done = [], [], [], 0
    for piece in _pieces(texts):
        words = Words(piece)
        if len(words):
            rows, back = word_buckets(words)
            hashes.append(np.unique(words.hash))
            buckets.append(rows)
        else:
            rows, back = np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64)
        split += [back[a:b] + done for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        done += len(rows)
    if not hashes:
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), split
    _, at, same = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return np.concatenate(buckets)[at], [same[x] for x in split]


def _flat(model: ToxicityModel, seen: dict) -> np.ndarray:
    """All parameters and the sums of squares of Adagrad, one behind the other."""
    named = _named(model)
    return np.concatenate([x.ravel() for _, x in named] + [seen.get(name, np.full_like(x, 1e-6)).ravel() for name, x in named]).astype(np.float32)


def _named(model: ToxicityModel) -> list[tuple[object, np.ndarray]]:
    return [("E", model.E), *((t, model.W[t]) for t in _TAPS), *((k, model.b[k]) for k in WIDTHS), ("v", model.v), ("c", model.c)]


def _filled(flat: np.ndarray, seed: int) -> tuple[ToxicityModel, dict]:
    model, seen, at = ToxicityModel(seed), {}, 0
    for _, x in _named(model):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    for name, x in _named(model):
        seen[name] = flat[at : at + x.size].reshape(x.shape).copy()
        at += x.size
    return model, seen


def _trained(share: float, times: int, rate: float, seed: int):
    """Trains on one shard in one pass, see ``training.passes``; ``share`` is that of label 1 in all texts."""

    def run(flat: np.ndarray, parts: Iterator[tuple[list[str], list[str]]], turn: int) -> np.ndarray:
        model, seen = _filled(flat, seed)
        rng = np.random.default_rng([seed, turn])
        for texts, labels in parts:
            y = np.array([int(v) for v in labels], np.float32)
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            rows, split = _word_rows(texts)
            order = rng.permutation(len(texts))
            turns = np.cumsum([len(split[d]) for d in order]) // BATCH_WORDS * len(order) + np.arange(len(order)) // 32
            for batch in np.split(order, np.flatnonzero(turns[1:] != turns[:-1]) + 1):
                _step(model, seen, rows, [split[d] for d in batch], y[batch], weight[batch], rate * (1 - 0.8 * turn / times))
        return _flat(model, seen)

    return run


def _thresholds(rows: DataFrame, model: ToxicityModel) -> dict[int, float]:
    """The best cut for all texts (-1), and for each language with 20 texts of both labels; counted on a grid of logits by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, labels in training.chunks(batches):
            z = model.logits(Words(pa.array(texts, pa.string())))
            lang = model.languages.predict(texts) if model.languages is not None and model.languages.languages else np.full(len(z), -1)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(z), pa.array(np.array([int(v) for v in labels], np.int64))], names=["lang", "z", "y"])

    seen = map_arrow(rows, run, "lang int, z double, y long").groupBy("lang", F.floor(F.col("z") * GRID).alias("at")).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum("y").alias("ones"), F.count("*").alias("n"))
    got = np.array([(r.lang, r["at"], r.low, r.high, r.ones, r.n - r.ones) for r in seen.collect()]).reshape(-1, 6)
    out = {-1: _cut(got)}
    for one in np.unique(got[:, 0]):
        own = got[got[:, 0] == one]
        if one >= 0 and min(own[:, 4].sum(), own[:, 5].sum()) >= 20:
            out[int(one)] = _cut(own)
    return out


def _cut(counted: np.ndarray) -> float:
    """The threshold with the best balanced accuracy; of equal ones the middle. Rows: language, place on the grid, least and largest logit, texts of label 1 and 0."""
    places, back = np.unique(counted[:, 1], return_inverse=True)
    low, high = np.full(len(places), np.inf), np.full(len(places), -np.inf)
    np.minimum.at(low, back, counted[:, 2])
    np.maximum.at(high, back, counted[:, 3])
    ones, zeros = (np.bincount(back, counted[:, c], len(places)) for c in (4, 5))
    cuts = np.concatenate([[low[0] - 1], (low[1:] + high[:-1]) / 2, [high[-1] + 1]])
    below1, below0 = (np.concatenate([[0], np.cumsum(x)]) for x in (ones, zeros))
    good = (ones.sum() - below1) / max(ones.sum(), 1) + below0 / max(zeros.sum(), 1)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang", rate: float = 0.05, seed: int = 0, shard_bytes: int = training.SHARD_BYTES) -> ToxicityModel:
    """Train on all texts with a label; ``labels`` holds only rows that may be learnt from.

    Every fifth text is held back for the thresholds (with under 100 the texts learnt from are used). Without both labels every score is 0.5 shifted to 0 (all rows harmless).
    ``lang`` (if any) teaches the recognition of languages from all texts of docs; it is no input of a score.
    """
    labels = labels.select(doc_id, F.col(label).cast("int").alias(label))
    rows, counts, _ = training.learnt(docs, labels, doc_id=doc_id, text=text, label=label, shard_bytes=shard_bytes)
    ones = sum(n for v, n in counts.items() if int(v) == 1)
    n = sum(counts.values())
    model = ToxicityModel(seed)
    if not 0 < ones < n:
        model.v[:] = 0
        model.threshold = {-1: 0.0 if ones else 1.0}
    else:
        few = n < 100
        times = int(min(MAX_PASSES, max(MIN_PASSES, -(-TEXTS_SEEN // n))))
        flat = training.passes(rows if few else rows.where(~training.held_back()), _flat(model, {}), _trained(ones / n, times, rate, seed), times)
        model, _ = _filled(flat, seed)
    if lang is not None:
        model.languages = language.fit_all(docs, doc_id=doc_id, text=text, lang=lang, shard_bytes=shard_bytes)
    if 0 < ones < n:
        held = rows if few else rows.where(training.held_back())
        model.threshold = _thresholds(held, model)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: ``doc_id, score, predicted``.

    Only the whole text counts; null and empty texts get the score of no words. Equal texts get equal scores,
    repeated rows stay, other columns are ignored and no rows give none.
    """
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", CHUNK_BYTES):
            s = model.scores(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([chunk.column("_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    return map_arrow(source, run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", doc_id)


def keep_harmless(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose whole text scores below 0.5 (a null text as one of no words)."""
    source, names, own = with_text(docs, text)
    plain = ", ".join(f"{c} {k}" for c, k in source.dtypes if c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, own, CHUNK_BYTES):
            yield chunk.filter(pa.array(model.scores(chunk.column(own)) < 0.5)).select(names)

    return map_arrow(source, run, plain).toDF(*docs.columns)
