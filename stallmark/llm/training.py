"""Models learnt from all labelled rows: tasks train on shards of the texts, and their changes are averaged pass by pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut, cut_seen, map_arrow, small
from .text import string_buffers, text_chunks

#: Bytes of text in a shard, on which one task trains at a time.
SHARD_BYTES = 32 << 20
#: Bytes of text that are decompressed and trained on together.
CHUNK_BYTES = 1 << 19
#: Pieces of the parameters that are averaged apart.
PIECES = 16


def learnt(docs: DataFrame, labels: DataFrame | None, *, doc_id: str, text: str, label: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, dict[str, int], int]:
    """Every labelled text, compressed, in shards and in an order by a hash of the id; the number of texts of each label; the number of shards.

    Columns: shard, h, label (as text), size, z. ``labels`` has doc_id and label (None: docs has it); null labels and ids are left out, equal
    rows count once. The shards do not depend on how docs is partitioned. Texts move once and are written once.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *([F.col(label).cast("string").alias("label")] if labels is None else []))
    if labels is not None:
        known, seen = cut_seen(labels.select(F.col(doc_id).alias("id"), F.col(label).cast("string").alias("label")).dropna().distinct())
        source = source.join(small(known, seen["n"]), "id")
    source = source.where("id is not null and label is not null")
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    source = source.withColumn("h", F.xxhash64("id", "label", "text")).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(41)), F.lit(n)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for chunk in text_chunks(batches, "text", 1 << 20):
            offsets, raw = string_buffers(chunk.column("text"))
            z = [codec.compress(raw[a:b], asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("shard", "h", "label")), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], names=["shard", "h", "label", "size", "z"])

    packed = map_arrow(source.select("shard", "h", "label", "text"), pack, "shard int, h long, label string, size long, z binary")
    rows = cut(packed.repartition(n, "shard").dropDuplicates(["shard", "h"]).sortWithinPartitions("shard", "h"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return rows, counts, n


def held_back(column: str = "h") -> Column:
    """Every fifth row, by its hash: thresholds are found on these."""
    return F.pmod(F.col(column), F.lit(5)) == 0


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(shard, texts, labels) of the rows of ``learnt``, some at a time, in order."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, size = batch.column("shard").to_numpy(), batch.column("size").to_numpy()
        ends, i = np.cumsum(size), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, "right")))
            j = min(j, int(np.searchsorted(shard, shard[i], "right")))
            part = batch.slice(i, j - i)
            texts = [codec.decompress(z, n, asbytes=True).decode("utf-8", "replace") if n else "" for z, n in zip(part.column("z").to_pylist(), size[i:j].tolist(), strict=True)]
            yield int(shard[i]), texts, part.column("label").to_pylist()
            i = j


def passes(rows: DataFrame, start: np.ndarray, train: Callable[[np.ndarray, Iterator[tuple[list[str], list[str]]], int], np.ndarray], times: int) -> np.ndarray:
    """The parameters after so many passes over all rows.

    In each pass, ``train`` takes the parameters (float32), the texts and labels of one shard, chunk by chunk, and the number of the pass, and
    returns the parameters it ends with. A parameter moves by the average of its changes in the shards that changed it. Tasks average pieces of
    the parameters over all shards; the driver gets one set of them a pass.
    """
    bounds = np.linspace(0, len(start), PIECES + 1).astype(int)
    for turn in range(times):
        shared = rows.sparkSession.sparkContext.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            ahead = chunks(batches)
            item = next(ahead, None)
            while item is not None:
                shard = item[0]

                def own() -> Iterator[tuple[list[str], list[str]]]:
                    nonlocal item
                    while item is not None and item[0] == shard:  # noqa: B023
                        yield item[1], item[2]
                        item = next(ahead, None)

                moved = train(shared.value.copy(), own(), turn) - shared.value
                pieces = [moved[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, shard, np.int32)), pa.array(pieces, pa.binary())], names=["piece", "shard", "moved"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total, count = None, None, None

            def done() -> pa.RecordBatch:
                mean = (total / np.maximum(count, 1)).astype(np.float32)
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["piece", "moved"])

            for batch in batches:
                for piece, moved in zip(batch.column("piece").to_pylist(), batch.column("moved"), strict=True):
                    own = np.frombuffer(moved.as_buffer(), np.float32)
                    if piece != at:
                        if at is not None:
                            yield done()
                        at, total, count = piece, np.zeros(len(own)), np.zeros(len(own))
                    total += own
                    count += own != 0
            if at is not None:
                yield done()

        moved = map_arrow(rows, run, "piece int, shard int, moved binary").repartition("piece").sortWithinPartitions("piece", "shard")
        start = start.copy()
        for r in cut(map_arrow(moved, average, "piece int, moved binary")).collect():
            start[bounds[r.piece] : bounds[r.piece + 1]] += np.frombuffer(r.moved, np.float32)
        shared.unpersist()
    return start
