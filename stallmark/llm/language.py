"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed subwords (two to four
characters inside a word, with its edges marked), followed by a linear softmax.
Both are trained with stochastic gradient descent in numpy on a bounded sample.
The confidence is calibrated with a temperature on rows held back from the
training, and a prediction is accepted where it reaches the confidence above
which those rows were right at the precision asked for. As both layers are linear,
one table of bucket times language gives the scores of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .sampling import fitted, labelled_texts
from .spark import map_arrow
from .text import text_chunks

SIZES = (2, 3, 4)
BITS = 14
BUCKETS = 1 << BITS
#: Bounds of the sample that the model is fitted on: texts of each language, bytes of all.
PER_LANGUAGE, MAX_BYTES = 800, 24 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, with a 0 for each run of others, behind a leading 0; which are letters; where each text ends."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    ends = np.cumsum(keep)[np.cumsum([len(t) + 1 for t in low], dtype=np.int64)] if low else np.zeros(0, np.int64)
    return np.where(letter, code, np.uint32(0))[keep], letter[keep], ends


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (positions x sizes) of the subwords around each character; those of no subword are ``BUCKETS``.

    Row i has the subwords that begin before character i of the stream; row 0 is
    missing. ``first`` has where the rows of each text begin (n + 1); the last array tells which texts have a letter.
    """
    code, letter, ends = _stream(texts)
    m = len(code)
    out = np.full((len(SIZES), max(m - 1, 0)), BUCKETS, np.int32)
    h, inside = code.copy(), np.ones(m, bool)
    for n in range(2, max(SIZES) + 1):
        if m < n:
            break
        if n > 2:
            inside = inside[: m - n + 1] & letter[n - 2 : m - 1]
        h = h[: m - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :]
        if n in SIZES:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[SIZES.index(n), : m - n + 1] = np.where(inside[: m - n + 1], g >> np.uint32(32 - BITS), np.uint32(BUCKETS))
    first = np.concatenate([[0], ends - 1]).astype(np.int64)
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = np.diff(seen[np.concatenate([[0], ends])]) > 0
    return out, first, has


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.languages, self.table, self.bias, self.temperature, self.floor = languages, table, bias, temperature, floor

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities (texts x languages) and which texts have a letter."""
        bucket, first, has = subwords(texts)
        n = len(self.languages)
        table = np.zeros((BUCKETS + 1, n + 1), np.float32)
        table[:BUCKETS, :n], table[:BUCKETS, n] = self.table, 1
        total = np.zeros((len(texts), n + 1))
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            part = table[bucket[0]]
            for b in bucket[1:]:
                part += table[b]
            total[full] = np.add.reduceat(part, first[full], axis=0, dtype=np.float64)
        z = (total[:, :n] / np.maximum(total[:, n:], 1) + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), has

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Index of the likeliest language, -1 without a letter."""
        p, has = self.probabilities(texts)
        return np.where(has, p.argmax(1), -1)


def train(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 6, rate: float = 4.0, precision: float = 0.99, seed: int = 0) -> LanguageModel:
    """Fit on texts with known languages; every fifth is held back for the calibration.

    With no text the model has no language; with one language it always says so.
    """
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.searchsorted(languages, langs)
    bags = []
    for i in range(0, len(texts), 64):
        b, first, _ = subwords(texts[i : i + 64])
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            own = b[:, lo:hi].ravel()
            u, c = np.unique(own[own < BUCKETS], return_counts=True)
            bags.append((u, (c / max(c.sum(), 1)).astype(np.float32)))
    full = np.array([len(u) > 0 for u, _ in bags])
    order = rng.permutation(len(texts))
    order = order[full[order]]
    held, fit = (order[::5], np.delete(order, np.arange(0, len(order), 5))) if len(order) >= 50 else (order, order)
    E = (rng.normal(size=(BUCKETS, dim)) / dim).astype(np.float32)
    W, bias = (rng.normal(size=(dim, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            x[k, bags[r][0]] = bags[r][1]
        return x

    weight = len(fit) / np.maximum(np.bincount(y[fit], minlength=len(languages)), 1) / len(languages) if len(fit) else np.ones(len(languages))
    for epoch in range(epochs):
        rng.shuffle(fit)
        lr = rate * (1 - epoch / epochs)
        for i in range(0, len(fit), 32):
            rows = fit[i : i + 32]
            x = dense(rows)
            hidden = x @ E
            z = hidden @ W + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = (p * weight[y[rows], None] / len(rows)).astype(np.float32)
            dW, dE = hidden.T @ g, x.T @ (g @ W.T)
            W -= lr * dW
            E -= lr * BUCKETS**0.5 / 8 * dE
            bias -= lr * 0.1 * g.sum(0)
    table = (E @ W).astype(np.float64)
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0)
    if not len(held):
        return model
    z = np.stack([table[bags[r][0]].T @ bags[r][1] for r in held]) + model.bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]))

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    s = z / model.temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    sure, right = p.max(1), p.argmax(1) == y[held]
    by = np.argsort(-sure)
    share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    enough = np.flatnonzero(share >= precision)
    model.floor = float(sure[by[enough[-1]]]) if len(enough) else 1.0
    return model


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES, **options) -> LanguageModel:
    """Train on a bounded sample of the rows of docs whose lang is known."""
    got = labelled_texts(docs, docs, doc_id=doc_id, text=text, label=lang, per_label=per_language, max_bytes=max_bytes)
    return fitted(got, lambda texts, langs: train(texts, [str(x) for x in langs], **options))


def _trained(languages: list[str], weight: np.ndarray, dim: int, times: int, rate: float):
    """Trains on one shard in one pass, see ``training.passes``; the parameters are embeddings, the layer over them and its bias."""
    k = len(languages)

    def run(flat: np.ndarray, parts: Iterator[tuple[list[str], list[str]]], turn: int) -> np.ndarray:
        E, W, bias = (x.reshape(s) for x, s in zip(np.split(flat, [BUCKETS * dim, (BUCKETS + k) * dim]), ((BUCKETS, dim), (dim, k), (k,)), strict=True))
        lr = rate * (1 - turn / times)
        for texts, langs in parts:
            y = np.searchsorted(languages, langs)
            bucket, first, _ = subwords(texts)
            bags = [np.unique(b[b < BUCKETS], return_counts=True) for b in (bucket[:, lo:hi].ravel() for lo, hi in zip(first[:-1], first[1:], strict=True))]
            full = np.flatnonzero([len(u) > 0 for u, _ in bags])
            for i in range(0, len(full), 32):
                rows = full[i : i + 32]
                used, back = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
                x = np.zeros((len(rows), len(used)), np.float32)
                owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
                x[owner, back] = np.concatenate([bags[r][1] / bags[r][1].sum() for r in rows])
                hidden = x @ E[used]
                z = hidden @ W + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                g = (p * weight[y[rows], None] / len(rows)).astype(np.float32)
                dW, dE = hidden.T @ g, x.T @ (g @ W.T)
                W -= lr * dW
                E[used] -= lr * BUCKETS**0.5 / 8 * dE
                bias -= lr * 0.1 * g.sum(0)
        return np.concatenate([E.ravel(), W.ravel(), bias])

    return run


def fit_all(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dim: int = 16, rate: float = 4.0, seed: int = 0, shard_bytes: int = training.SHARD_BYTES) -> LanguageModel:
    """Train on all texts of docs whose lang is known, shard by shard; not calibrated (``predict`` does not depend on it)."""
    rows, counts, _ = training.learnt(docs, None, doc_id=doc_id, text=text, label=lang, shard_bytes=shard_bytes)
    languages, n = sorted(counts), sum(counts.values())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng, k = np.random.default_rng(seed), len(languages)
    start = np.concatenate([(rng.normal(size=BUCKETS * dim) / dim), rng.normal(size=dim * k) * 0.1, np.zeros(k)]).astype(np.float32)
    weight = n / np.array([counts[x] for x in languages]) / k
    times = int(min(12, max(1, -(-6_000 // n))))
    flat = training.passes(rows, start, _trained(languages, weight, dim, times, rate), times)
    E, W, bias = np.split(flat, [BUCKETS * dim, (BUCKETS + k) * dim])
    return LanguageModel(languages, (E.reshape(BUCKETS, dim) @ W.reshape(dim, k)).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: ``doc_id, lang_pred, score, accepted``.

    The whole text counts and nothing but the text. A text that is null, empty or
    without a letter is ``und`` with score 0 and not accepted, as is every text if
    the model has seen no language. ``score`` is the calibrated probability;
    ``accepted`` tells whether it reaches the calibrated floor. Equal texts get
    equal rows, repeated rows stay, texts of any length are read whole, other columns are ignored (whatever their names) and an empty table gives no row.
    """
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", 1 << 19):
            n = chunk.num_rows
            has, best, top = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
            if model.languages:
                p, has = model.probabilities(chunk.column("text").to_pylist())
                best, top = p.argmax(1), p.max(1)
            names = [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("_id"), pa.array(names, pa.string()), pa.array(np.where(has, top, 0.0)), pa.array(has & (top >= model.floor))], names=["_id", "lang_pred", "score", "accepted"])

    return map_arrow(source, run, f"_id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("_id", doc_id)
