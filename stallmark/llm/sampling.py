"""Bounded, repeatable samples of labelled rows, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import cut, map_arrow

#: Longer texts are not learnt from.
MAX_TEXT_BYTES = 1 << 18
#: Labels that are learnt, the most frequent ones; so a sample has at most this many times ``per_label`` rows.
MAX_LABELS = 200


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null for null)."""
    return F.crc32(column.cast("string").cast("binary")) % n


def labelled_texts(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, per_label: int, max_bytes: int) -> DataFrame:
    """(id, label, text): at most ``per_label`` texts of each label and ``max_bytes`` bytes, the first by a hash of the id.

    Texts of more than ``MAX_TEXT_BYTES`` are not learnt from; none is cut. As that shows only
    when the picked ids meet their texts, a label with such texts may have fewer.

    ``labels`` has doc_id and label, already without the rows that may not be
    learnt from; null labels and ids are left out. Ids are picked without their
    texts, from the lowest hashes that are enough for each label; the picked ones (at
    most ``per_label`` for each of ``MAX_LABELS`` labels) then meet the texts in one scan.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).dropna().distinct().withColumn("h", F.xxhash64("id"))
    count = known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS)
    # Four times as many as needed, by the hash: no label is sorted whole.
    near = known.join(F.broadcast(count), "label").where(F.col("h").cast("double") / 2.0**64 + 0.5 <= 4.0 * per_label / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= per_label).select("id", "label", "h")
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TEXT_BYTES).join(F.broadcast(picked), "id")
    so_far = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return texts.withColumn("so_far", F.sum(F.octet_length("text").cast("long")).over(so_far)).where(F.col("so_far") <= max_bytes).select("h", "id", "label", "text")


def fitted(sample: DataFrame, train: Callable[[list[str], list], object]) -> object:
    """What ``train`` makes of the texts and labels of a bounded sample, in one task: the driver never has the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("h", "id", "text")])
            model = train(rows.column("text").to_pylist(), rows.column("label").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = cut(map_arrow(sample.coalesce(1), run, "model binary")).collect()
    return pickle.loads(got[0].model) if got else train([], [])
