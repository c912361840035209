"""Document fingerprints: sketches scaled by a threshold.

Of the shingles of a text (five words) each with a hash below a fixed fraction of all hashes
is kept, as 48 bits. The size of a sketch follows the text's, so that the
containment of a short text in a very long one can be estimated, and sketches of parts
merge to the sketch of the whole. A sketch is a string of eight characters (base64)
for each hash, in rising order of the hashes. A text none of whose hashes is low enough keeps its lowest one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark import map_arrow
from .text import Words, string_buffers, text_chunks

SHINGLE, FRACTION = 5, 1 / 8
_BITS = 48
CHUNK = 1 << 20


class Sketches:
    """The sketches of texts as flat arrays: hashes ``value`` of text ``doc``, sorted by both."""

    def __init__(self, texts: pa.Array, fraction: float = FRACTION, k: int = SHINGLE):
        words = Words(texts)
        self.n = words.n_docs
        doc, value = [], []
        for size in range(1, k + 1):  # a text of fewer words is one shingle
            fits = words.room(size)
            own = np.repeat(np.arange(self.n), words.counts)[: len(fits)]
            at = np.flatnonzero(fits & ((words.counts[own] >= k) if size == k else (words.counts[own] == size)))
            if len(at):
                doc.append(own[at])
                value.append(words.grams(size)[at] >> np.uint64(64 - _BITS))
        doc, value = np.concatenate([np.zeros(0, np.int64), *doc]), np.concatenate([np.zeros(0, np.uint64), *value])
        low = value < np.uint64(int(fraction * 2.0**_BITS))
        least = np.full(self.n, np.uint64(1 << _BITS))
        np.minimum.at(least, doc, value) if len(doc) else None
        none = np.bincount(doc[low], minlength=self.n) == 0
        keep = low | (none[doc] & (value == least[doc])) if len(doc) else low
        doc, value = doc[keep], value[keep]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        self.doc, self.value = doc[new], value[new]
        self.size = np.bincount(self.doc, minlength=self.n)

    def strings(self) -> pa.Array:
        raw = self.value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BITS // 8 :]
        offsets = np.concatenate([[0], np.cumsum(self.size * 8)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), self.n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(base64.b64encode(raw.tobytes()))])

    def slice(self, start: int, stop: int) -> Sketches:
        """The texts from start to stop alone, counted from 0."""
        out = object.__new__(Sketches)
        a, b = np.searchsorted(self.doc, [start, stop])
        out.n, out.doc, out.value, out.size = stop - start, self.doc[a:b] - start, self.value[a:b], self.size[start:stop]
        return out

    def common(self, other: Sketches) -> np.ndarray:
        """For each text, how many hashes its sketch shares with the other's."""
        doc, value = np.concatenate([self.doc, other.doc]), np.concatenate([self.value, other.value])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        twice = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
        return np.bincount(doc[1:][twice], minlength=self.n)


def jaccard_of(a: Sketches, b: Sketches) -> np.ndarray:
    """The estimated share of common shingles among those of either text; 1 if both have none."""
    both = a.common(b)
    union = a.size + b.size - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def containment_of(a: Sketches, b: Sketches) -> np.ndarray:
    """The estimated share of a's shingles that b has; 1 if a has none."""
    return np.where(a.size > 0, a.common(b) / np.maximum(a.size, 1), 1.0)


def codes(sketch: Column) -> Column:
    """The hashes of a sketch, as an array of strings."""
    return F.regexp_extract_all(sketch, F.lit(".{8}"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    x, y = codes(a), codes(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has, however much longer b is."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(codes(a), codes(b))), F.size(codes(a))), F.lit(1.0))


def _value(code: Column) -> Column:
    return F.conv(F.hex(F.unbase64(code)), 16, 10).cast("long")


def merge_codes(pieces: DataFrame, keys: list[str], sketch: str, *, fraction: float = FRACTION) -> DataFrame:
    """(keys, sketch): the sketch of all texts of a group together, from their sketches.

    Rows are added up code by code before a group's codes meet in one row; a lowest hash that was kept for want of others gives way to lower ones.
    """
    rows = pieces.select(*keys, F.explode(codes(F.col(sketch))).alias("code")).distinct().withColumn("h", _value(F.col("code")))
    merged = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "code"))).alias("all"))
    below = F.filter("all", lambda x: x["h"] < int(fraction * 2.0**_BITS))
    kept = F.when(F.size(below) > 0, below).otherwise(F.slice("all", 1, 1))
    return merged.select(*keys, F.array_join(F.transform(kept, lambda x: x["code"]), "").alias(sketch))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row, without a shuffle; a null or empty text has an empty one."""
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", CHUNK):
            lengths = pa.array(_Points(chunk.column("text")).count)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), lengths, Sketches(chunk.column("text"), fraction, k).strings()], names=["id", "n_chars", "fingerprint"])

    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", doc_id)


class _Points:
    """Code points of texts that lie one behind the other in a buffer."""

    def __init__(self, texts: pa.Array):
        offsets, raw = string_buffers(texts)
        self.raw = raw[offsets[0] : offsets[-1]]
        self.offset = offsets - offsets[0]
        self.at = np.flatnonzero((self.raw & 0xC0) != 0x80)
        self.first = np.searchsorted(self.at, self.offset)
        self.count = np.diff(self.first).astype(np.int64)

    def byte(self, doc: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Where code point ``point`` of a text begins; its end for the number of its points."""
        return np.append(self.at, len(self.raw))[self.first[doc] + point]


def _edited(texts: pa.Array, share: int) -> tuple[np.ndarray, pa.Array]:
    """Code points of all texts but the last, and these texts with their last part replaced by the beginning of the next."""
    p = _Points(texts)
    doc = np.arange(len(texts) - 1)
    new = p.count[:-1] // share
    head = p.byte(doc, p.count[:-1] - new)
    tail = p.byte(doc + 1, np.minimum(new, p.count[1:]))
    raw = memoryview(p.raw.tobytes())
    pieces = [x for a, b, c, d in zip(p.offset[:-2].tolist() if len(doc) else [], head.tolist(), p.offset[1:-1].tolist(), tail.tolist(), strict=True) for x in (raw[a:b], raw[c:d])]
    size = head - p.offset[:-2] + tail - p.offset[1:-1]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return p.count[:-1], pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(pieces))]).cast(pa.string())


def _ranges(keys: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The first keys (a, h) of ranges of about equally many rows, in order: bounded by ``parts``."""
    ranged = keys.repartitionByRange(parts, "a", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("a", "h")).alias("k"))
    got = sorted((r.k.a, r.k.h) for r in ranged.collect())
    return np.array([x for x, _ in got], np.int64), np.array([x for _, x in got], np.int64)


def _place(a: np.ndarray, h: np.ndarray, low_a: np.ndarray, low_h: np.ndarray) -> np.ndarray:
    """The last range that begins at or before each key."""
    right = np.searchsorted(low_a, a, "right")
    out = right - 1
    tied = np.flatnonzero(np.searchsorted(low_a, a, "left") < right)
    for x in np.unique(a[tied]):
        left, end = np.searchsorted(low_a, x, "left"), np.searchsorted(low_a, x, "right")
        rows = tied[a[tied] == x]
        out[rows] = left + np.searchsorted(low_h[left:end], h[rows], "right") - 1
    return out


def neighbours(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, k: int = SHINGLE, share: int = 3, parts: int | None = None) -> DataFrame:
    """Each row with its sketch and those of an edited text and of the next document.

    Columns: ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, held_edited, held_next``
    (near: ``jaccard_of``, held: ``containment_of``). The next document is the one with the
    next smaller id; the last one's is the first. The edited text ends, instead of with its last n_chars // ``share`` code
    points, with as many (or all) of the next's first ones. Null texts are empty and have empty sketches, alike only to such. Null ids come last;
    rows with one id are ordered by a hash of their texts, so that repeated rows are each other's next.
    A single row is its own next. Ids are integers. Other columns are ignored. An empty table gives no row.

    Texts are shuffled once, compressed, to ranges of ids of about as many rows, and
    stream through a task in order. The first row of a range is sent to the range before it as well.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.select("id", F.bitwise_not(F.coalesce("id", F.lit(-(1 << 63)))).alias("a"), F.xxhash64("text").alias("h"), "text")
    low_a, low_h = _ranges(source.select("a", "h"), parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n = max(1, len(low_a))
    schema = pa.schema([("part", pa.int32()), ("copy", pa.int32()), ("a", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("z", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for chunk in text_chunks(batches, "text", CHUNK):
            a, h = chunk.column("a").to_numpy(), chunk.column("h").to_numpy()
            part = _place(a, h, low_a, low_h)
            first = np.flatnonzero((low_a[part] == a) & (low_h[part] == h))
            rows = np.concatenate([np.arange(len(a)), first])
            offsets, raw = string_buffers(chunk.column("text"))
            pieces = [codec.compress(raw[s:e], asbytes=True) if e > s else b"" for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, (part[first] - 1) % n]).astype(np.int32)), pa.array(np.repeat([0, 1], [len(a), len(first)]).astype(np.int32)),
                 *(chunk.column(c).take(taken) for c in ("a", "h", "id")), pa.array(np.diff(offsets)[rows]), pa.array(pieces, pa.binary()).take(taken)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, before = pa.Codec("zstd"), None
        for batch in batches:
            ends, i = np.cumsum(batch.column("size").to_numpy()), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
                rows = pa.Table.from_batches([batch.slice(i, j - i)] if before is None else [before, batch.slice(i, j - i)]).combine_chunks()
                before, i = batch.slice(j - 1, 1), j
                texts = pa.array([codec.decompress(z, size, asbytes=True) if size else b"" for z, size in zip(rows.column("z").to_pylist(), rows.column("size").to_pylist(), strict=True)], pa.binary()).cast(pa.string())
                m = rows.num_rows - 1
                if m:
                    count, edited = _edited(texts, share)
                    all_own, new = Sketches(texts, fraction, k), Sketches(edited, fraction, k)
                    own, after = all_own.slice(0, m), all_own.slice(1, m + 1)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id").chunk(0).slice(0, m), pa.array(count), edited, own.strings(), new.strings(), pa.array(jaccard_of(own, new)), pa.array(jaccard_of(own, after)),
                         pa.array(containment_of(own, new)), pa.array(containment_of(own, after)), rows.column("copy").chunk(0).slice(0, m)],
                        names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_edited", "held_next", "copy"],
                    ).filter(pa.array(rows.column("copy").to_numpy()[:m] == 0))

    dealt = map_arrow(source, deal, "part int, copy int, a long, h long, id long, size long, z binary")
    ordered = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "copy", "a", "h")
    out = map_arrow(ordered, compare, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double, held_next double, copy int")
    return out.drop("copy").withColumnRenamed("id", doc_id)
