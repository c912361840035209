"""From hashed buckets to exact links and groups, without emitting pairs.

Steps that the near-duplicate operators share:

1. ``candidate_edges``: rows (key, id, sketch) are dealt by key; rows of one key
   are compared by their sketches, and a spanning forest of the pairs that may be
   similar is emitted - fewer edges than rows, however large the bucket.
   ``trie_edges`` does it for the nodes of prefix tries: a node of more than a block is
   met at its longest prefix first, and only representatives at the shorter one.
2. ``connected_components`` joins the forests.
3. ``verified_links`` or ``linked_groups``: the connected rows meet with their whole
   payload and are compared exactly. The first compares every pair and counts the
   links; the second finds the groups only, mostly through representatives.

A key with more than ``BLOCK`` rows is dealt in blocks by a hash of the id, and where
all pairs must meet, each pair of blocks is a group of its own. So no group in a task
exceeds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import cut, cut_seen, map_arrow, small

#: Rows of one key that are compared in one task; two blocks at most meet.
BLOCK = 512
#: Bytes of payload in a block.
BLOCK_BYTES = 8 << 20

Alike = Callable[[np.ndarray, np.ndarray, bool], np.ndarray]


def _share(member: Column, parts: Column, salt: int = 17) -> Column:
    return F.pmod(F.xxhash64(member, F.lit(salt)), parts).cast("int")


Payload = Callable[[DataFrame], DataFrame]


def _large(df: DataFrame, key: str, block: int, size: str | None = None) -> tuple[DataFrame, int]:
    """The keys of more than a block (or ``BLOCK_BYTES``, with a column of sizes) with the number of blocks they make (``_m``), and how many keys these are."""
    parts = F.ceil(F.count("*") / block)
    if size is not None:
        parts = F.greatest(parts, F.ceil(F.sum(F.col(size).cast("long")) / BLOCK_BYTES))
    large, seen = cut_seen(df.groupBy(key).agg(parts.cast("int").alias("_m")).where("_m > 1"))
    return large, seen["n"]


def _large_nodes(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``_large`` for the many keys of buckets, of which few are large.

    Only keys that two of a 32nd of the ids have are counted. One of just over a block is missed with a
    chance of 2e-6, a larger one practically never; it then makes a group of more than a block, no other result.
    """
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(99)), F.lit(32)) == 0).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some, seen = cut_seen(some)
    if not seen["n"]:
        return some.withColumn("_m", F.lit(1)), 0
    return _large(rows.join(small(some, seen["n"]), "key", "left_semi"), "key", block)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def in_blocks(df: DataFrame, key: str, member: Column, large: tuple[DataFrame, int]) -> DataFrame:
    """df dealt by key, large keys (see ``_large``) in pairs of blocks; adds ``_i, _j`` (the pair) and ``_b`` (the row's block)."""
    keys, n = large
    if not n:
        return _dealt(df.withColumns({c: F.lit(0) for c in ("_i", "_j", "_b")}), key)
    out = df.join(small(keys, n), key, "left").withColumn("_p", F.coalesce("_m", F.lit(1))).withColumn("_b", _share(member, F.col("_p")))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    out = out.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_m", "_p", "_o")
    return _dealt(out, key, "_i", "_j")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows and where the groups begin (n + 1); about ``limit`` rows or one group each."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
                rest = table.slice(at[-1])
                held, rows = rest.to_batches(), rest.num_rows
    if rows:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table), table.num_rows)


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each row, from a symmetric boolean matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            near = linked[front].any(0) & (root < 0)
            front = np.flatnonzero(near)
            root[front] = i
    return root


def _sketches(column: pa.ChunkedArray, n: int, width: int) -> np.ndarray:
    part = column.combine_chunks()
    part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
    start = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
    return np.frombuffer(part.buffers()[2], np.uint8)[start : start + n * width].reshape(n, width)


def _forests(alike: Alike, width: int, keys: list[str], roots: str | None = None):
    """Arrow function: edges of a spanning forest of the alike rows of each group.

    If ``_i`` and ``_j`` are keys and differ, only rows of different blocks are compared. With
    ``roots`` (a column of 0 and 1), rows of 1 that are roots of their group come out too, with key and sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, keys, 20_000):
            ids = table.column("id").to_numpy()
            sketch = _sketches(table.column("sketch"), len(ids), width)
            side = table.column("_b").to_numpy()
            mixed = table.column("_i").to_numpy() != table.column("_j").to_numpy() if "_i" in keys else np.zeros(len(ids), bool)
            root_of = np.ones(len(ids), bool)
            size = np.diff(at)
            a, b = [], []
            up = table.column(roots).to_numpy()[at[:-1]] > 0 if roots else np.zeros(len(size), bool)
            whole = (size > 8) | (up & (size > 1))
            tiny = np.repeat(np.where(whole, 0, size), size)
            group = np.repeat(np.arange(len(size)), size)
            for o in range(1, 8):  # small groups: all pairs at a distance of o, of all groups at once
                left = np.flatnonzero((tiny[:-o] > o) & (group[o:] == group[:-o]) & ~(mixed[o:] & (side[o:] == side[:-o]))) if len(ids) > o else np.zeros(0, int)
                left = left[ids[left] != ids[left + o]]
                left = left[alike(sketch[left], sketch[left + o], False)] if len(left) else left
                a.append(ids[left])
                b.append(ids[left + o])
            for g in np.flatnonzero(whole):
                own = np.arange(at[g], at[g + 1])
                linked = alike(sketch[own], sketch[own], True)
                if mixed[own[0]]:
                    linked &= side[own][:, None] != side[own][None]
                order = np.argsort(ids[own], kind="stable")
                root = forest(linked[np.ix_(order, order)])
                move = np.flatnonzero(root != np.arange(len(own)))
                root_of[own[order[move]]] = False
                a.append(ids[own[order[move]]])
                b.append(ids[own[order[root[move]]]])
            a_, b_ = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            keep = a_ != b_
            columns = [np.maximum(a_, b_)[keep], np.minimum(a_, b_)[keep]]
            if roots is None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b"])
                continue
            if len(columns[0]):
                none = pa.nulls(len(columns[0]))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), none.cast(pa.int64()), none.cast(pa.binary())], names=["a", "b", "key", "sketch"])
            if len(apart := np.flatnonzero(root_of & np.repeat(up, size))):
                top = table.take(pa.array(apart))
                yield pa.RecordBatch.from_arrays([top.column(c).combine_chunks() for c in ("id", "id", "key", "sketch")], names=["a", "b", "key", "sketch"])

    return run


def candidate_edges(rows: DataFrame, alike: Alike, width: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a > b, that connect all pairs of one key which ``alike`` lets through.

    ``rows`` has key, id (longs) and sketch (binary of ``width`` bytes). ``alike``
    takes two uint8 arrays (n x width) and tells whether rows may be similar: row by
    row, or with a true third argument each with each. The same edge may come from several keys.
    """
    rows = rows.select("key", "id", "sketch")
    dealt = in_blocks(rows, "key", F.col("id"), _large_nodes(rows, block))
    return map_arrow(dealt, _forests(alike, width, ["key", "_i", "_j"]), "a long, b long")


def trie_edges(rows: DataFrame, alike: Alike, width: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a > b, that connect the alike rows of the nodes of prefix tries.

    ``rows`` has key (the node of the shortest prefix), tail (the labels below it), id
    and sketch. A node of at most a block is compared whole. A larger one is dealt at its
    longest prefix (key and tail), and a leaf that is still larger in blocks; the rows
    found alike there are one group, and only its representative is met at the shorter
    prefix, where all pairs of representatives are compared (in pairs of blocks, if need be).
    """
    rows = rows.select("key", "tail", "id", "sketch")
    large, n = _large_nodes(rows, block)
    if not n:
        dealt = rows.withColumn("_b", F.lit(0)).repartition("key").sortWithinPartitions("key", "tail")
        return map_arrow(dealt, _forests(alike, width, ["key"]), "a long, b long")
    leaves, seen = cut_seen(rows.join(small(large, n), "key").groupBy("key", "tail").agg(F.ceil(F.count("*") / block).cast("int").alias("_l")).where("_l > 1"))
    dealt = rows.join(small(large, n), "key", "left").withColumn("_up", F.col("_m").isNotNull().cast("int")).withColumn("_t", F.when(F.col("_up") == 1, F.col("tail")).otherwise(-1))
    if seen["n"]:
        dealt = dealt.join(small(leaves, seen["n"]), ["key", "tail"], "left").withColumn("_b", _share(F.col("id"), F.coalesce("_l", F.lit(1))))
    else:
        dealt = dealt.withColumn("_b", F.lit(0))
    dealt = _dealt(dealt.select("key", "_t", "_b", "_up", "id", "sketch"), "key", "_t", "_b")
    out = cut(map_arrow(dealt, _forests(alike, width, ["key", "_t", "_b"], "_up"), "a long, b long, key long, sketch binary"))
    tops = out.where("sketch is not null").select("key", F.col("a").alias("id"), "sketch")
    return out.where("sketch is null").select("a", "b").unionByName(candidate_edges(tops, alike, width, block))


def cell_edges(rows: DataFrame, alike: Alike, width: int, block: int = BLOCK) -> DataFrame:
    """``candidate_edges`` for keys whose rows are mostly alike; the components are the same, whatever the rows.

    Rows of a large key meet in its blocks first, and the representatives of what is found alike there with each
    other. Where that leaves a key in several groups, counting edges of other keys too, the rows outside of the
    largest meet all rows of the key. So n near copies cost a comparison with one block each, and no row is
    copied for each block. ``rows`` is read several times: have it written.
    """
    rows = rows.select("key", "id", "sketch")
    large, n = _large_nodes(rows, block)
    if not n:
        return map_arrow(in_blocks(rows, "key", F.col("id"), (large, 0)), _forests(alike, width, ["key", "_i", "_j"]), "a long, b long")
    dealt = rows.join(small(large, n), "key", "left").withColumn("_up", F.col("_m").isNotNull().cast("int")).withColumn("_b", _share(F.col("id"), F.coalesce("_m", F.lit(1))))
    met = cut(map_arrow(_dealt(dealt.select("key", "_b", "_up", "id", "sketch"), "key", "_b"), _forests(alike, width, ["key", "_b"], "_up"), "a long, b long, key long, sketch binary"))
    tops = met.where("sketch is not null").select("key", F.col("a").alias("id"), "sketch")
    edges = cut(met.where("sketch is null").select("a", "b").unionByName(candidate_edges(tops, alike, width, block)))
    labels = connected_components(edges).withColumnRenamed("component", "label")
    inside = cut(rows.select("key", "id").join(small(large, n), "key").join(labels, "id", "left").select("key", "_m", "id", F.coalesce("label", "id").alias("label")))
    sizes = inside.groupBy("key", "_m", "label").agg(F.count("*").alias("c"))
    split, seen = cut_seen(sizes.groupBy("key", "_m").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most")).where(F.col("all") > F.col("most")))
    if not seen["n"]:
        return edges
    split = split.withColumn("_r", F.least("_m", F.ceil((F.col("all") - F.col("most")) * F.col("_m") / F.col("all"))).cast("int")).drop("all", "most")
    apart = rows.join(inside.select("key", "id", "label"), ["key", "id"]).join(small(split, seen["n"]), "key")
    # A group for each block of the rest (_i) and each block of all rows (_j, below 0 so that it differs).
    rest = apart.where("label <> top").withColumns({"_i": _share(F.col("id"), F.col("_r"), 18), "_b": F.lit(0)}).withColumn("_j", F.explode(F.sequence(-F.col("_m"), F.lit(-1))))
    every = apart.withColumns({"_j": -1 - _share(F.col("id"), F.col("_m")), "_b": F.lit(1)}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)))
    dealt = _dealt(rest.unionByName(every.select(rest.columns)).select("key", "_i", "_j", "_b", "id", "sketch"), "key", "_i", "_j")
    return edges.unionByName(map_arrow(dealt, _forests(alike, width, ["key", "_i", "_j"]), "a long, b long"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge; the component is the smallest id that edges reach.

    Alternates large-star and small-star steps until nothing changes: a few rounds,
    each written to the shared checkpoint folder. The large star's minima are aggregated before
    they are shuffled and written before they are joined back, so that AQE can split a node
    of very many edges; if they are few they are broadcast. A small star is about the minima around a node,
    which are few.
    """
    check = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    edges, state = cut_seen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), check)
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    while state["n"]:
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        least, seen = cut_seen(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # Large star: each larger neighbour of a node is tied to the node's minimum.
        large = both.join(small(least, seen["n"]), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are tied to their minimum.
        tied = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select(F.inline(F.array(pair("b", "m"), pair("a", "m"))))
        edges, now = cut_seen(tied.where("a <> b").distinct(), check)
        if now == state:
            break
        state = now
    ends = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())


def _verify(dealt: DataFrame, compare: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(component, id, links, root) of the rows of each group (component, _i, _j); if _i and _j differ only rows of different ``_b`` are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, ["component", "_i", "_j"], 256):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                group = table.slice(lo, hi - lo)
                linked = compare(group)
                np.fill_diagonal(linked, False)
                ids, weight, side = (group.column(c).to_numpy() for c in ("id", "weight", "_b"))
                if group.column("_i")[0].as_py() != group.column("_j")[0].as_py():
                    linked &= side[:, None] != side[None]
                order = np.argsort(ids, kind="stable")
                root = forest(linked[np.ix_(order, order)])
                yield pa.RecordBatch.from_arrays([group.column("component").combine_chunks(), pa.array(ids[order]), pa.array((linked @ weight)[order].astype(np.int64)), pa.array(ids[order][root])], names=["component", "id", "links", "root"])

    return map_arrow(dealt, run, "component long, id long, links long, root long")


def verified_links(members: DataFrame, compare: Callable[[pa.Table], np.ndarray], payload: Payload, size: str | None = None, block: int = BLOCK) -> DataFrame:
    """(id, links, root) for each member, from the exact comparison of all pairs of a component.

    ``members`` (written before) has component, id, weight (longs) and maybe a column of sizes;
    ``payload`` joins what is compared to such rows. ``compare`` takes a table of one group and returns its
    symmetric boolean matrix of links. ``links`` is the weight of the linked members, ``root`` the
    smallest id that links reach inside one pair of blocks; an id has a row for each.
    """
    dealt = in_blocks(payload(members), "component", F.col("id"), _large(members, "component", block, size))
    return _verify(dealt, compare).drop("component")


def linked_groups(members: DataFrame, compare: Callable[[pa.Table], np.ndarray], payload: Payload, size: str | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between members whose components are those of all links inside the components of ``members``.

    Arguments are those of ``verified_links``. A component of at most a block is compared whole. A larger one
    is dealt in blocks, and the representatives of the groups found there are compared with each other. What then is
    still apart is made sure of: the rows outside of the largest group meet all rows of their
    component. Near copies of one text, however many, so cost a comparison with one block each.
    """
    large, n = _large(members, "component", block, size)
    whole = payload(members)
    whole = whole.join(small(large, n), "component", "left") if n else whole.withColumn("_m", F.lit(1))
    whole = whole.withColumn("_b", _share(F.col("id"), F.coalesce("_m", F.lit(1)))).withColumns({"_i": F.col("_b"), "_j": F.col("_b")}).drop("_m")
    first = cut(_verify(_dealt(whole, "component", "_i", "_j"), compare).drop("links"))
    edges = first.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if not n:
        return edges
    hot = first.join(small(large.select("component"), n), "component")
    tops = cut(members.join(hot.where("id = root").select("id"), "id", "left_semi"))
    more = verified_links(tops, compare, payload, size, block)
    more = cut(more.select(F.col("id").alias("a"), F.col("root").alias("b")))
    labels = connected_components(hot.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)).withColumnRenamed("component", "label")
    known = cut(hot.select("component", "id").join(labels, "id", "left").select("component", "id", F.coalesce("label", "id").alias("label")))
    by_label = known.groupBy("component", "label").agg(F.count("*").alias("c"))
    split, seen = cut_seen(by_label.groupBy("component").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most")).where(F.col("all") > F.col("most")))
    edges = edges.unionByName(more)
    if not seen["n"]:
        return edges
    parts = split.join(small(large, n), "component").select("component", "top", "_m", F.least("_m", F.ceil((F.col("all") - F.col("most")) * F.col("_m") / F.col("all"))).cast("int").alias("_r"))
    rows = payload(members.join(known.select("id", "label"), "id").join(small(parts, seen["n"]), "component"))
    # A group for each block of the rest (_i) and each block of all rows (_j, below 0 so that it differs).
    rest = rows.where("label <> top").withColumns({"_i": _share(F.col("id"), F.col("_r"), 18), "_b": F.lit(0)}).withColumn("_j", F.explode(F.sequence(-F.col("_m"), F.lit(-1))))
    all_rows = rows.withColumns({"_j": -1 - _share(F.col("id"), F.col("_m")), "_b": F.lit(1)}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)))
    dealt = _dealt(rest.unionByName(all_rows.select(rest.columns)), "component", "_i", "_j")
    return edges.unionByName(_verify(dealt, compare).select(F.col("id").alias("a"), F.col("root").alias("b")))
