"""Whitening of embeddings by a tall-and-skinny QR factorisation.

An entry c counts as the integer floor(scale * c) + shift. One pass adds up these integers exactly;
a second centres the rows by the sums (n * x - S is an integer, rounded once as it
becomes a double) and reduces each partition to the R of its QR factorisation. The R factors are merged
in a tree, ``FAN_IN`` at a time, and the last one's singular value decomposition gives
the components: right vectors, and variances as squares of singular values. The
covariance is never formed, so that small variances keep their digits. What the driver has is
as large as one R.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import cut, map_arrow

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Factors that one task merges.
FAN_IN = 16
#: Rows that are worked on together.
ROWS = 4096
#: Entries beyond this do not fit the exact integers.
LARGEST = 2.0**40
_WIDE = "decimal(38,0)"


def _usable(v):
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(array: pa.ListArray, dim: int, scale: int, shift: int) -> np.ndarray:
    c = array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if len(c) and np.abs(c).max() > LARGEST:
        raise ValueError(f"an embedding has an entry beyond {LARGEST:g}")
    return np.floor(scale * c).astype(np.int64) + shift


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: exact integers, of 64 bits where they fit."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row: of 21-bit limbs, so that 64 bits hold each sum."""
    if d.dtype == object:
        return [int(y) for y in (d * d).sum(1)]
    a, b, c = d >> 42, (d >> 21) & 0x1FFFFF, d & 0x1FFFFF
    parts = [((x * y).sum(1), s) for x, y, s in ((a, a, 84), (a, b, 64), (a, c, 43), (b, b, 42), (b, c, 22), (c, c, 0))]
    return [sum(int(v) << s for v, (_, s) in zip(row, parts, strict=True)) for row in zip(*(p.tolist() for p, _ in parts), strict=True)]


def _row_factor(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def _matrix(value: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(-1, dim)


def _sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, int, list[int]]:
    """Dimension (the most frequent one, of equally frequent ones the largest), rows of it and the exact sums of their entries."""
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return 0, 0, []
    dim, n = most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for part in _slices(batches):
            total += _integers(part.column("v"), dim, scale, shift).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["place", "s"])

    parts = map_arrow(rows.where(F.size("v") == dim).select("v"), run, f"place int, s {_WIDE}")
    sums = {r.place: int(r.s) for r in parts.groupBy("place").agg(F.sum("s").cast(_WIDE).alias("s")).collect()}
    return dim, n, [sums[i] for i in range(dim)]


def row_factor(rows: DataFrame, dim: int, n: int, sums: list[int], scale: int = SCALE, shift: int = SHIFT, fan_in: int = FAN_IN) -> np.ndarray:
    """R of the QR factorisation of all centred rows (column ``v``): one for each partition, merged in a tree."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for part in _slices(batches):
            r = _row_factor(r, _centred(_integers(part.column("v"), dim, scale, shift), n, sums).astype(np.float64) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["place", "r"])

    def merge(factors: pa.Table) -> pa.Table:
        r = None
        for value in factors.sort_by("place").column("r").to_pylist():
            r = _row_factor(r, _matrix(value, dim))
        return pa.table({"place": factors.column("up").slice(0, 1), "r": pa.array([r.tobytes()], pa.binary())})

    factors = cut(map_arrow(rows.select("v"), leaf, "place long, r binary"))
    most = factors.agg(F.max("place")).first()[0] or 0
    while most:
        factors = factors.withColumn("up", F.expr(f"place div {fan_in}")).groupBy("up").applyInArrow(merge, "place long, r binary")
        most //= fan_in
    got = factors.collect()
    return _matrix(got[0].r, dim) if got else np.zeros((0, dim))


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each usable row of vectors and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so
    are those of another length than the most frequent one. Rows with a null id and
    repeated rows count as such. ``deviation`` (decimal) is the exact sum over the dimensions
    of (n * x - S)^2. Components go by falling variance, one for each dimension
    at most; of equal variances any orthonormal vectors are right, the same for all rows. A component
    without variance (as with one row, or equal rows) explains 0 and has null as ``whitened``.
    ``identity_error`` is measured on the rows: the largest absolute entry of the covariance of the other
    components' whitened values minus the identity (null without any).
    Entries beyond ``LARGEST`` are an error. Other columns are ignored. An empty table gives no row.
    """
    source = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = source.where(F.coalesce(_usable(F.col("v")), F.lit(False)))
    kind = source.schema["id"].dataType.simpleString()
    dim, n, sums = _sums(rows, scale, shift)
    rows = rows.where(F.size("v") == dim)
    k = min(components, dim)
    r = row_factor(rows, dim, n, sums, scale, shift, fan_in) if n else np.zeros((0, dim))
    sigma, right = np.linalg.svd(r, full_matrices=True)[1:] if n else (np.zeros(0), np.zeros((0, dim)))
    sigma = np.concatenate([sigma, np.zeros(dim - len(sigma))])
    variance = sigma * sigma / max(n, 1)
    live = sigma[:k] > (sigma[0] if dim else 0.0) * dim * np.finfo(np.float64).eps
    explained = variance[:k] / variance.sum() if live.any() else np.zeros(k)
    axes = right[:k][live].T / np.sqrt(variance[:k][live])

    def project(d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / n) @ axes

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = axes.shape[1]
        total = np.zeros((m + 1, m + 1))
        for part in _slices(batches):
            w = project(_centred(_integers(part.column("v"), dim, scale, shift), n, sums))
            w = np.concatenate([w, np.ones((len(w), 1))], 1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "s"])

    error = None
    if live.any():
        got = map_arrow(rows.select("v"), products, "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).toArrow().sort_by("place")
        m = axes.shape[1]
        total = got.column("s").to_numpy().reshape(m + 1, m + 1) / n
        error = float(np.abs(total[:m, :m] - np.outer(total[m, :m], total[m, :m]) - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            d = _centred(_integers(part.column("v"), dim, scale, shift), n, sums)
            out = np.full((len(d), k), np.nan)
            out[:, live] = project(d)
            each = np.repeat(np.arange(len(d)), k)
            deviation = pa.array([Decimal(x) for x in _squares(d)], pa.decimal128(38, 0))
            white = pa.array(out.ravel(), mask=np.tile(~live, len(d)))
            component = np.tile(np.arange(k), len(d))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(each)), pa.array((component + 1).astype(np.int32)), pa.array(np.full(len(each), n, np.int64)), deviation.take(pa.array(each)), white, pa.array(explained[component])],
                names=["id", "component", "n", "deviation", "whitened", "explained"],
            )

    out = map_arrow(rows, run, f"id {kind}, component int, n long, deviation {_WIDE}, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("id", vec_id)
