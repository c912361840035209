"""Embedding near-duplicates by lattice hashing.

Each of several tables projects a unit vector to two times eight dimensions at
random and decodes both to the nearest point of the lattice E8; the two points
are the cell. Besides its own cell a vector is put in the nearest neighbouring
cells: those of the two points of either block that are closest among the 240
around its own. Vectors that meet in a cell are compared by bytes, with a bound that loses no
pair, and the connected ones by cosine in double precision (see ``groups``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import groups
from .spark import cut, map_arrow
from .text import mix

THRESHOLD = 0.95
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 2, 0.6


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    p = np.round(x)
    odd = np.flatnonzero(p.sum(-1) % 2 != 0)
    if len(odd):
        e = x[odd] - p[odd]
        worst = np.abs(e).argmax(-1)
        p[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
    return p


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of x (n x 8)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(near[:, None], a, b)


def e8_neighbours(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest minimal vectors to add to p, of both kinds (2 x n x 8), and how much farther (squared) x is from there."""
    e = x - p
    sign, size = np.where(e >= 0, 1.0, -1.0), np.abs(e)
    n = np.arange(len(x))
    order = np.argsort(-size, axis=1)
    one = np.zeros_like(x)
    for j in (0, 1):
        one[n, order[:, j]] = sign[n, order[:, j]]
    half = sign / 2
    odd = (sign < 0).sum(1) % 2 == 1
    half[n[odd], order[odd, 7]] *= -1
    steps = np.stack([one, half])
    return steps, 2 - 2 * (steps * e[None]).sum(-1)


def cells(x: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = 5) -> np.ndarray:
    """Keys (n x tables * (1 + probes)) of the cells of unit vectors x."""
    n, dim = x.shape
    rng = np.random.default_rng([seed, dim])
    out = np.zeros((n, tables * (1 + probes)), np.uint64)
    coefficient = mix(np.arange(1, 8 * blocks + 1, dtype=np.uint64)) | np.uint64(1)
    for t in range(tables):
        y = x @ (rng.normal(size=(dim, 8 * blocks)) * scale)
        points, moves, extra = [], [], []
        for b in range(blocks):
            z = y[:, 8 * b : 8 * b + 8]
            p = e8(z)
            steps, far = e8_neighbours(z, p)
            points.append(p)
            for s, f in zip(steps, far, strict=True):
                move = np.zeros((n, 8 * blocks))
                move[:, 8 * b : 8 * b + 8] = s
                moves.append(move)
                extra.append(f)
        home = np.concatenate(points, 1)
        order = np.argsort(np.stack(extra), axis=0, kind="stable")[:probes]
        all_moves = np.stack(moves)
        for j in range(1 + probes):
            cell = home if j == 0 else home + all_moves[order[j - 1], np.arange(n)]
            twice = np.round(2 * cell).astype(np.int64).view(np.uint64)
            out[:, t * (1 + probes) + j] = mix((twice * coefficient).sum(1, dtype=np.uint64) + np.uint64(t + 1))
    return out


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def byte_bound(threshold: float, dim: int) -> float:
    """The least cosine of two rounded vectors whose own cosine reaches the threshold."""
    turn = np.arcsin(min(1.0, dim**0.5 * 0.5 / 127))
    return float(np.cos(min(np.pi, np.arccos(threshold) + 2 * turn + 1e-6)))


def _rows(array: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors padded with zeros to dim, and their own lengths."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(length), dim))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out, length


def embedding_links(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, block: int = groups.BLOCK) -> DataFrame:
    """A row for each row of vectors: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``,
    ``component_id`` is the smallest id that links reach, ``kept`` tells whether
    it is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite numbers, and rows with a null id, link with nothing and are kept;
    vectors of different lengths do not link with each other. A cosine of exactly the threshold (as numpy computes it in double precision) links. Equal vectors all
    link; repeated rows count as such, and rows with one id and different vectors are told apart.
    Ids are integers. Other columns are ignored. An empty table gives no row.
    """
    if not isinstance(vectors.schema[vec_id].dataType, T.IntegralType):
        raise TypeError(f"{vec_id} must be an integer column")
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k1", F.when(F.col("good"), F.xxhash64("v"))).withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(3), "v")))
    # Classes of equal vectors have a number of their own, as ids may repeat.
    classes = cut(rows.where("good").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    dim = classes.agg(F.max(F.size("v"))).first()[0] or 1
    bound = byte_bound(threshold, dim)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = unit(_rows(part.column("v"), dim)[0])
                keys = cells(x, tables).view(np.int64)
                small = np.round(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
                n, m = keys.shape
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * dim).tobytes()), pa.py_buffer(small.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m, pa.array(keys.ravel())), sketch], names=["id", "keys", "sketch"])

    def alike(a: np.ndarray, b: np.ndarray, outer: bool) -> np.ndarray:
        a, b = (x.view(np.int8).astype(np.float32) for x in (np.ascontiguousarray(a), np.ascontiguousarray(b)))
        a, b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, b))
        return ((a @ b.T) if outer else (a * b).sum(1)) >= bound - 1e-5

    def compare(table: pa.Table) -> np.ndarray:
        x, length = _rows(table.column("v").combine_chunks(), dim)
        x = unit(x)
        return (x @ x.T >= threshold) & (length[:, None] == length[None])

    buckets = map_arrow(classes.select("id", "v"), hashed, "id long, keys array<long>, sketch binary")
    edges = groups.cell_edges(cut(buckets).select(F.explode(F.array_distinct("keys")).alias("key"), "id", "sketch"), alike, dim, block)
    members = cut(classes.select("id", "weight").join(groups.connected_components(edges), "id"))
    linked = cut(groups.verified_links(members, compare, lambda df: df.join(classes.select("id", "v"), "id"), block=block))
    reached = groups.connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "id", "least", "weight").join(links, "id", "left").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = cut(known.select("k1", "k2", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    known = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("k1", "k2", "component_id", "n_links")
    out = rows.select("id", "good", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(vec_id), F.when(F.col("good"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
