"""Benchmark decontamination by winnowing.

Training texts and test items are split into words (see ``text``). Of each window
of ``span`` words (10) the smallest hash of its ``k``-word grams is the
fingerprint, on both sides. Two texts that share ``span`` words share all grams
in them, and therefore the smallest: every shared span of that length is found.
Fingerprints of the texts are joined with those of the items, together with the words of
their windows, compared as bytes; overlapping and adjoining windows are then extended
to spans. An item of fewer words than ``span``, but not none, is one window of its own
length and its own fingerprint.

Texts are never shuffled. A Bloom filter of the item fingerprints goes to them,
of at most ``FILTER_BITS`` bits however many items there are; only the windows whose
fingerprint passes it are carried on, and join the items' windows by a join
of Spark's choice. A filter that many items fill lets more windows through; the rows stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import cut, map_arrow, with_text
from .text import Words, mix, text_chunks

SPAN, GRAM = 10, 5
#: Bits of the filter: at least, and at most (8 MB); between them 8 for each window of an item.
LEAST_BITS, FILTER_BITS = 1 << 16, 1 << 26
_PROBES = 6
_KEY = ["print", "n", "window"]
_FOUND = "found array<struct<start:int,n:int,print:long,window:string>>"
_STRUCT = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("print", pa.int64()), ("window", pa.string())])


def filter_bits(prints: np.ndarray, bits: int) -> np.ndarray:
    """The bits (``_PROBES`` x n) that a filter of this size (a power of two) has for these fingerprints."""
    step = mix(prints) | np.uint64(1)
    return ((prints + np.arange(_PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)).astype(np.int64)


def passing(packed: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Places in ``prints`` of those that the filter (bytes) may hold: all that it holds and few others."""
    mask, step, at = np.uint64(len(packed) * 8 - 1), mix(prints) | np.uint64(1), np.arange(len(prints))
    for i in range(_PROBES):
        bit = ((prints[at] + np.uint64(i) * step[at]) & mask).astype(np.int64)
        at = at[(packed[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
    return at


def window_prints(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place, the smallest k-gram of its window and whether the window lies in one text; and the places of the grams that are smallest somewhere."""
    w = span - k + 1
    grams, fits = words.grams(k), words.room(span)
    if not len(fits):
        return np.zeros(0, np.uint64), fits, np.zeros(0, np.int64)
    low = grams[: len(fits)].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + len(fits)], out=low)
    picked = np.zeros(len(grams), bool)
    for j in range(w):
        picked[j : j + len(fits)] |= fits & (grams[j : j + len(fits)] == low)
    return low, fits, np.flatnonzero(picked)


def _item_windows(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", 1 << 20):
            words = Words(chunk.column("text"))
            own = np.repeat(np.arange(words.n_docs), words.counts)
            for n in sorted({int(min(c, span)) for c in words.counts if c}):
                prints, fits = window_prints(words, span, k)[:2] if n == span else (words.grams(n), words.room(n))
                own_n = own[: len(fits)]
                at = np.flatnonzero(fits & ((words.counts[own_n] >= span) if n == span else (words.counts[own_n] == n)))
                text = pa.array([words.span(i, n).decode() for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(prints[at].view(np.int64)), pa.array(np.full(len(at), n, np.int32)), text, chunk.column("id").take(pa.array(own_n[at]))], names=[*_KEY, "item"])

    return run


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(filter_bits(batch.column("print").to_numpy().view(np.uint64), bits))
            if len(bit):
                first = np.flatnonzero(np.concatenate([[True], np.diff(bit >> 6) > 0]))
                held = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(bit[first] >> 6), pa.array(held.view(np.int64))], names=["place", "held"])

    return run


class _Tests:
    """The windows of the items, written once, their lengths, and the filter of their fingerprints."""

    def __init__(self, items: DataFrame, item_id: str, item_text: str, span: int, k: int, filter_limit: int):
        tests = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
        self.span, self.k = span, k
        self.windows = cut(map_arrow(tests, _item_windows(span, k), "print long, n int, window string, item string").distinct())
        lengths = {r.n: r["count"] for r in self.windows.groupBy("n").count().collect()}
        bits = LEAST_BITS
        while bits < min(filter_limit, 8 * sum(lengths.values())):
            bits *= 2
        self.lengths = sorted(lengths)
        words = np.zeros(bits // 64, np.int64)
        if lengths:  # one row for each 64 bits of the filter, at most
            got = map_arrow(self.windows.select("print").distinct(), _bits(bits), "place long, held long").groupBy("place").agg(F.bit_or("held").alias("held")).toArrow()
            words[got.column("place").to_numpy()] = got.column("held").to_numpy()
        self.filter = words.view(np.uint8)

    def finder(self) -> Callable[[Words], pa.Array]:
        """Gives, for each text, its windows whose fingerprint passes the filter."""
        span, k, lengths, packed = self.span, self.k, self.lengths, self.filter

        def find(words: Words) -> pa.Array:
            starts, sizes, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for n in lengths:
                if n == span:
                    grams = words.grams(k)
                    low, fits, at = window_prints(words, span, k)
                    at = at[passing(packed, grams[at])]
                    near = np.zeros(len(fits), bool)
                    for j in range(span - k + 1):  # the windows that have the gram as fingerprint
                        s = at - j
                        p = at[(s >= 0) & (s < len(fits))]
                        s = p - j
                        near[s[fits[s] & (low[s] == grams[p])]] = True
                    at, own = np.flatnonzero(near), low
                else:
                    own = words.grams(n)
                    at = np.flatnonzero(words.room(n))
                    at = at[passing(packed, own[at])]
                starts.append(at)
                sizes.append(np.full(len(at), n, np.int32))
                prints.append(own[at])
            start, size, print_ = (np.concatenate(x) for x in (starts, sizes, prints))
            doc = words.doc_of(start)
            order = np.argsort(doc, kind="stable")
            start, size, print_, doc = start[order], size[order], print_[order], doc[order]
            text = pa.array([words.span(i, n).decode() for i, n in zip(start.tolist(), size.tolist(), strict=True)], pa.string())
            found = pa.StructArray.from_arrays([pa.array((start - words.first[doc]).astype(np.int32)), pa.array(size), pa.array(print_.view(np.int64)), text], fields=list(_STRUCT))
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(words.n_docs + 1)).astype(np.int32)), found)

        return find

    def meet(self, rows: DataFrame) -> DataFrame:
        """(_row, start, n, item) of the windows of the rows that an item has too."""
        windows = rows.select("_row", F.explode("found").alias("w")).select("_row", "w.*")
        return windows.join(self.windows, _KEY)


def _spans(met: DataFrame) -> DataFrame:
    """(_row, spans): overlapping and adjoining windows as one range of words each, in order."""
    w = Window.partitionBy("_row").orderBy("start", "end")
    ends = met.select("_row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    ends = ends.withColumn("_top", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_span", F.sum(F.coalesce((F.col("_top") < F.col("start")).cast("long"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = ends.groupBy("_row", "_span").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("range"))
    return ranges.groupBy("_row").agg(F.sort_array(F.collect_list("range")).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM, filter_limit: int = FILTER_BITS) -> DataFrame:
    """A row for each row of docs: ``doc_id, n_words, spans, items, n_hit, n_items, contaminated``.

    ``spans`` are word ranges [start, end) inside the text that occur in an item,
    ``items`` the sorted ids (as strings) of the items with an occurring window.
    Null or empty texts have no words and no hits; null or empty items match
    nothing; a null item id is the string ``null``. Equal items are all named.
    Rows of docs stay apart even with the same id or a null one. Other columns are ignored.
    An empty docs gives no row, without items every row is clean. docs is read once;
    what is written of it is the id, the number of words and the windows that may be an item's.
    """
    tests = _Tests(items, item_id, item_text, span, k, filter_limit)
    find = tests.finder()
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            words = Words(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([chunk.column("_id"), pa.array(words.counts.astype(np.int64)), find(words)], names=["_id", "n_words", "found"])

    kind = source.schema["_id"].dataType.simpleString()
    rows = cut(map_arrow(source, run, f"_id {kind}, n_words long, {_FOUND}").withColumn("_row", F.monotonically_increasing_id()))
    some = rows.where(F.size("found") > 0)
    met = cut(tests.meet(some).select("_row", "start", "n", "item"))
    names = met.select("_row", "item").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = some.select("_row", "_id", "n_words").join(_spans(met).join(names, "_row"), "_row", "left").drop("_row")
    clean = rows.where(F.size("found") == 0).select("_id", "n_words", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    out = hit.unionByName(clean)
    out = out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    return out.select(F.col("_id").alias(doc_id), "n_words", "spans", "items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM, filter_limit: int = FILTER_BITS) -> DataFrame:
    """The rows of docs, with all their columns, whose text shares no window with an item; null texts stay.

    docs is read twice and must be the same both times: once for the rows without
    a window that passes the filter, which stay as they are, and once for the others, the only
    ones that are written and joined.
    """
    tests = _Tests(items, item_id, item_text, span, k, filter_limit)
    find = tests.finder()
    source, names, own = with_text(docs, text)
    plain = ", ".join(f"{c} {t}" for c, t in source.dtypes if c in names)

    def part(clean: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches, own):
                found = find(Words(chunk.column(own)))
                here = pa.array((np.diff(found.offsets.to_numpy()) == 0) == clean)
                out = chunk.filter(here).select(names)
                yield out if clean else pa.RecordBatch.from_arrays([*out.columns, found.filter(here)], names=[*names, "found"])

        return run

    some = cut(map_arrow(source, part(False), f"{plain}, {_FOUND}").withColumn("_row", F.monotonically_increasing_id()))
    bad = tests.meet(some).select("_row").distinct()
    kept = some.join(bad, "_row", "left_anti").select(names)
    return map_arrow(source, part(True), plain).unionByName(kept).toDF(*docs.columns)
