"""N-gram Jaccard join over documents with a MinHash LSH forest.

A text is the set of its shingles of five words (lower-cased; a text of fewer words,
but not none, is one shingle). Texts with the same words in the same order are
one class with a count. Each class has a signature of ``MAX_DEPTH`` minima in each of
``TREES`` prefix tries, whose rows are dealt and sorted by it.

Matched prefixes are shortened from the whole signature until the target recall is reached:
not below ``shortest_prefix``, the length with which pairs at the threshold meet in some
trie with that recall (5 by default), and in steps by the data. A node of at most a block of rows is
met at that length at once. In a larger one the rows that share the whole signature are
matched first, and only one representative of each group found goes on to the shorter prefix (see
``groups.trie_edges``). Candidates are told by a sketch of 32 minima from below the
shortest prefix, kept far below the threshold, and the connected ones verified by
their exact shingle sets.

Tries, representatives and sketches miss a few pairs, so that the components of the forest are
completed: of a set of n shingles, in one order for all sets, the first n - ceil(threshold * n) + k hold k that
are shared with any set at the threshold whose own are as many. Texts with fewer than that among what other components
have are left, the rest is told by sizes and parities of their sets: bounds that leave out no pair at the threshold. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import groups
from .spark import cut, cut_seen, map_arrow, small
from .text import Words, gram_hash, mix, odd_constants, text_chunks

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, MAX_DEPTH = 20, 8
SKETCH = 32
#: Words of 64 bits of the parities of a set, and bytes of them with the size of the set.
PARITY = 32
SET_BYTES = 8 * (PARITY + 1)
#: Shingles that come last in the order of all: so many of the most frequent ones at most, found in a 32nd of the texts more often than this. They change no result.
MAX_HOT, HOT = 100_000, 16
#: The share of a set by which its first shingles are more than one shared one asks for.
MORE = 0.05


def shortest_prefix(threshold: float, recall: float, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets in some trie with this recall (1 if none is short enough)."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def sketch_floor(threshold: float, miss: float = 2e-5) -> int:
    """The largest number of equal minima that pairs at the threshold fall below with at most this chance."""
    from math import comb

    below, k = 0.0, 0
    while (below := below + comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)) <= miss:
        k += 1
    return k


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and the text of each, in order of the texts (repeats included)."""
    at = np.flatnonzero(words.room(n))
    hashes, owner = words.grams(n)[at], words.doc_of(at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = np.array([gram_hash(words.hash[words.first[d] : words.first[d + 1]], int(words.counts[d]))[0] for d in short], np.uint64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def lowered_words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts.fill_null("")))


def _frequent(source: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that many texts have, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            hashes, owner = shingles(lowered_words(chunk.column("text")), n)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[fresh].view(np.int64))], names=["h"])

    some = map_arrow(source.where(F.pmod(F.col("k1"), F.lit(32)) == 0).select("text"), run, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > HOT).orderBy(F.desc("c"), "h").limit(MAX_HOT)
    return np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64))


def _first_shingles(hashes: np.ndarray, starts: np.ndarray, threshold: float, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text (they begin at ``starts``) its first shingles, how many these are, how many at least it shares with any set at the threshold, and parities and size of its set."""
    value = hashes >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        value |= (hot[at] == hashes).astype(np.uint64) << np.uint64(63)
    text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(value) else np.zeros(0, bool)
    value, text = value[fresh], text[fresh]
    size = np.bincount(text, minlength=len(starts))
    sets = np.zeros((len(starts), PARITY + 1), np.uint64)
    np.bitwise_xor.at(sets, (text, ((value >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)), np.uint64(1) << (value & np.uint64(63)))
    sets[:, PARITY] = size
    room = size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1 + (MORE * size).astype(np.int64)
    need = 1 + np.maximum(MORE * threshold * size - 1e-6, 0).astype(np.int32)  # a set at the threshold may be that much smaller
    first = np.arange(len(value)) - (np.cumsum(size) - size)[text] < room[text]
    return value[first].view(np.int64), np.bincount(text[first], minlength=len(starts)), need, sets


def _may_reach(threshold: float):
    """Bounds of the Jaccard index of sets: parities that differ are at most the elements that one set alone has."""
    most = (1 - threshold) / (1 + threshold)

    def alike(a: np.ndarray, b: np.ndarray, outer: bool) -> np.ndarray:
        x, y = a.view(np.uint64), b.view(np.uint64)
        if outer:
            x, y = x[:, None], y[None]
        differ = sum(np.bitwise_count(x[..., i] ^ y[..., i]).astype(np.int32) for i in range(PARITY))
        m, n = x[..., PARITY].astype(np.float64), y[..., PARITY].astype(np.float64)
        return (differ <= most * (m + n) + 1e-6) & (np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-6)

    return alike


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the keys that several components share."""
    for table, at in groups.runs(batches, ["key"], 100_000):
        component = table.column("component").to_numpy()
        mixed = np.minimum.reduceat(component, at[:-1]) != np.maximum.reduceat(component, at[:-1])
        yield from table.filter(pa.array(np.repeat(mixed, np.diff(at)))).to_batches()


def _completed(marked: DataFrame, classes: DataFrame, maybe: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, component): the components ``maybe``, joined where texts of different ones may reach the threshold."""
    of_class = classes.select("id").join(maybe, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    first = marked.select(F.col("_key").alias("id"), "prefix", "need").join(of_class, "id")
    rows = first.select(F.explode("prefix").alias("key"), "id", "component", "need")
    schema = "key long, id long, component long, need int"
    before = None
    while True:
        rows, seen = cut_seen(map_arrow(_dealt_by_key(rows), _of_several, schema))
        if not seen["n"]:
            return maybe
        ids, many = cut_seen(rows.groupBy("id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("id"))
        if not many["n"]:
            return maybe
        rows = rows.join(small(ids, many["n"]), "id", "left_semi").select("key", "id", "component", "need")
        if before is not None and many["n"] > 0.8 * before:
            break
        before = many["n"]
    sets = marked.select(F.col("_key").alias("id"), F.col("sets").alias("sketch")).join(small(ids, many["n"]), "id", "left_semi")
    rows = rows.select("key", "id").join(small(sets, 20 * many["n"]), "id")  # a set has some 20 times the bytes of a row of numbers
    more = groups.candidate_edges(rows, _may_reach(threshold), SET_BYTES, block)
    return groups.connected_components(more.unionByName(maybe.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def _dealt_by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def _signatures(depth: int, trees: int, n: int, carried: list[str], threshold: float, hot: np.ndarray):
    """Arrow function: the class of each text, the nodes of its shortest prefixes, the labels below them (in one number that sorts like them), the sketch and what ``_first_shingles`` gives."""
    below = MAX_DEPTH - depth
    k = max(MAX_DEPTH * trees, depth * trees + SKETCH)
    factor = odd_constants(k, 11).astype(np.uint32) | np.uint32(1)
    shift = (odd_constants(k, 12) >> np.uint64(32)).astype(np.uint32)
    salt = odd_constants(trees, 13)
    bits = 30 // below if below else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            words = lowered_words(chunk.column("text"))
            hashes, owner = shingles(words, n)
            docs, starts = np.unique(owner, return_index=True)
            small_hash = (hashes >> np.uint64(32)).astype(np.uint32)
            low = np.zeros((k, len(docs)), np.uint32)
            if len(docs):
                for i in range(k):
                    np.minimum.reduceat(small_hash * factor[i] + shift[i], starts, out=low[i])
            keys, tails = np.zeros((trees, len(docs)), np.uint64), np.zeros((trees, len(docs)), np.int32)
            for t in range(trees):
                key = np.full(len(docs), salt[t], np.uint64)
                for row in low[t * depth : (t + 1) * depth]:
                    key = mix(key ^ row.astype(np.uint64))
                keys[t] = key
                for j in range(below):
                    label = low[depth * trees + t * below + j] * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
                    tails[t] = tails[t] << bits | label.astype(np.int32)
            sketch = (low[depth * trees : depth * trees + SKETCH] >> np.uint32(7)).astype(np.uint8).T.tobytes()
            # Two hashes of the word sequence make the class.
            place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
            c = []
            for seed in (21, 22):
                part = mix(words.hash + mix(place.astype(np.uint64) + np.uint64(seed << 40)))
                c.append(np.add.reduceat(part, words.first[docs]).astype(np.int64) if len(docs) else np.zeros(0, np.int64))
            has = np.zeros(words.n_docs, bool)
            has[docs] = True
            take = pa.array(np.where(has, np.cumsum(has) - 1, 0), mask=~has)
            prefix, count, need, sets = _first_shingles(hashes, starts, threshold, hot)
            offsets = np.arange(len(docs) + 1, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(offsets * trees, pa.array(x.T.ravel())) for x in (keys.view(np.int64), tails)]
            sketches = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((offsets * SKETCH).tobytes()), pa.py_buffer(sketch)])
            prefixes = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(prefix))
            parities = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((offsets * SET_BYTES).tobytes()), pa.py_buffer(sets.tobytes())])
            made = [*(pa.array(x) for x in c), *lists, sketches, prefixes, pa.array(need), parities]
            yield pa.RecordBatch.from_arrays([*(chunk.column(x) for x in carried), *(x.take(take) for x in made)], names=[*carried, "c1", "c2", "keys", "tails", "sketch", "prefix", "need", "sets"])

    return run


def _alike(least: int):
    def alike(a: np.ndarray, b: np.ndarray, outer: bool) -> np.ndarray:
        if not outer:
            return (a == b).sum(1) >= least
        out = np.zeros((len(a), len(b)), np.uint8)
        for i in range(a.shape[1]):
            out += a[:, i, None] == b[None, :, i]
        return out >= least

    return alike


def _shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text and its number, piece by piece, as the arrays of a text are many times its size."""
    hashes, owner, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in text_chunks(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t"):
        h, o = shingles(lowered_words(piece.column("t")), n)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
        hashes.append(h[fresh])
        owner.append(o[fresh] + done)
        done += piece.num_rows
    return np.concatenate(hashes), np.concatenate(owner)


def jaccard_links(texts: pa.Array, threshold: float, n: int = SHINGLE, width: int = 8192) -> np.ndarray:
    """Which of the texts have a Jaccard index of their shingle sets of at least the threshold; exact, in blocks of shingles."""
    hashes, owner = _shingle_sets(texts, n)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    size = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else first
    column = np.cumsum(first[shared] | (np.diff(np.concatenate([[-1], column[shared]])) > 0)) - 1 if shared.any() else column[:0]
    owner = owner[shared]
    both = np.zeros((len(texts), len(texts)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(texts), min(width, int(column[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    union = size[:, None] + size[None] - both
    return (both / np.maximum(union, 1) >= threshold) & (union > 0)


#: Columns of the source that go along with the signatures.
CARRIED = ["_doc", "k1", "k2", "size"]


class _Found:
    """The rows of docs with their classes of equal texts, and the component of each class.

    ``rows`` (written) has _key (of the row), _doc, c1, c2 and what was carried along; ``known`` has
    c1, c2, doc, id (the key) and hashes of the class's first row, its weight, component (the smallest key) and, if asked for, links.
    """

    def __init__(self, source: DataFrame, carried: list[str], threshold: float, recall: float, shingle: int, trees: int, block: int, count: bool):
        run = _signatures(shortest_prefix(threshold, recall, trees), trees, shingle, carried, threshold, _frequent(source, shingle))
        kinds = dict(source.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", c1 long, c2 long, keys array<long>, tails array<int>, sketch binary, prefix array<long>, need int, sets binary"
        marked = cut(map_arrow(source, run, schema).withColumn("_key", F.monotonically_increasing_id()))
        first = F.min(F.struct(F.col("_doc").alias("doc"), F.col("_key").alias("id"), "k1", "k2", "size")).alias("first")
        made = ["keys", "tails", "sketch"]
        classes = marked.where("_doc is not null and c1 is not null").groupBy("c1", "c2").agg(first, F.count("*").alias("weight"), *(F.first(c).alias(c) for c in made))
        classes = cut(classes.select("c1", "c2", "first.*", "weight", *made))
        nodes = classes.select("id", "sketch", F.explode(F.arrays_zip("keys", "tails")).alias("x")).select("x.keys", "x.tails", "id", "sketch").toDF("key", "tail", "id", "sketch")
        maybe = groups.connected_components(groups.trie_edges(nodes, _alike(sketch_floor(threshold)), SKETCH, block))
        maybe = _completed(marked, classes, maybe, threshold, block)
        members, seen = cut_seen(classes.select("id", "weight", "k1", "k2", "size").join(maybe, "id"))
        texts = source.select("k1", "k2", F.coalesce("text", F.lit("")).alias("text"))
        repeated = cut_seen(marked.select("k1", "k2").join(small(members.select("k1", "k2"), seen["n"]), ["k1", "k2"]).groupBy("k1", "k2").count().where("count > 1").limit(1))[1]["n"]

        def payload(df: DataFrame) -> DataFrame:
            out = texts.join(small(df, seen["n"]), ["k1", "k2"])
            return out.dropDuplicates(["k1", "k2"]) if repeated else out

        compare = lambda g: jaccard_links(g.column("text").combine_chunks(), threshold, shingle)
        known = classes.select("c1", "c2", "doc", "id", "k1", "k2", "weight")
        if count:
            linked = cut(groups.verified_links(members, compare, payload, "size", block))
            edges = linked.select(F.col("id").alias("a"), F.col("root").alias("b"))
            known = known.join(linked.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        else:
            edges = groups.linked_groups(members, compare, payload, "size", block)
        known = known.join(groups.connected_components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
        self.rows, self.known = marked.drop(*made, "prefix", "need", "sets"), cut(known)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The id, the text, and two hashes of both, by which the row is found again."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column")
    source = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("text"))
    return source.withColumns({"k1": F.xxhash64("_doc", "text"), "k2": F.xxhash64(F.lit(5), "text", "_doc"), "size": F.octet_length("text")})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, trees: int = TREES, block: int = groups.BLOCK) -> DataFrame:
    """A row for each row of docs: ``doc_id, class_id, n_links, kept``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard index of
    at least ``threshold`` with this one's, all of them (``recall`` is that of the tries alone); ``class_id`` is the smallest id that
    links reach and ``kept`` tells whether it is the row's own. Ids are integers.
    Repeated rows count as copies of each other; rows with one id and different texts are
    compared like any others. Texts without words (null, empty, signs only) and rows with a null id
    link with nothing and are kept. Other columns are ignored. An empty docs gives no row.

    All pairs of connected texts are compared, so that m different texts that
    link with each other take about m^2 / 2 comparisons, in pairs of blocks.
    """
    found = _Found(_source(docs, doc_id, text), CARRIED, threshold, recall, shingle, trees, block, True)
    least = found.known.groupBy("component").agg(F.min("doc").alias("class_id"))
    known = found.known.join(least, "component").select("c1", "c2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = found.rows.select("_doc", "c1", "c2").join(known, ["c1", "c2"], "left")
    lone = F.col("_doc").isNull() | F.col("c1").isNull()
    class_id = F.when(lone, F.col("_doc")).otherwise(F.col("class_id"))
    return out.select(F.col("_doc").alias(doc_id), class_id.alias("class_id"), F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.coalesce(class_id == F.col("_doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, trees: int = TREES, block: int = groups.BLOCK) -> DataFrame:
    """One row of docs, with all its columns, for each class of ``near_duplicates``; rows with a null id stay, as do texts without words.

    It is a row with the smallest id of its class, of several with this id one of those with
    a text of the class, and of rows equal in both any one. No links are counted:
    large groups are compared by representatives (see ``groups.linked_groups``).
    docs is read three times and must be the same each time: for the signatures, for the texts of
    the candidates and for the result. Only the numbers of the rows that go are written.
    """
    found = _Found(_source(docs, doc_id, text), CARRIED, threshold, recall, shingle, trees, block, False)
    best = F.min(F.struct("doc", "id", "k1", "k2")).alias("best")
    shared = found.known.groupBy("component").agg(best, F.sum("weight").alias("all")).where("all > 1").select("component", F.col("best.k1").alias("s1"), F.col("best.k2").alias("s2"))
    rows = found.known.select("c1", "c2", "component").join(shared, "component").join(found.rows, ["c1", "c2"])
    rows = rows.withColumn("_stays", (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    marks = rows.groupBy("k1", "k2").agg(F.bool_or("_stays").alias("_stays"), F.count("*").alias("_n")).where("not _stays or _n > 1").select("k1", "k2", "_stays")
    marks, seen = cut_seen(marks, F.count_if("_stays").alias("repeated"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in (doc_id, text)}
    plain = docs.toDF(*names)
    hashed = plain.withColumns({"k1": F.xxhash64(at[doc_id].cast("long"), at[text].cast("string")), "k2": F.xxhash64(F.lit(5), at[text].cast("string"), at[doc_id].cast("long"))})
    hashed = hashed.withColumn("k1", F.when(at[doc_id].isNotNull(), F.col("k1")))
    out = hashed.join(small(marks.select("k1", "k2"), seen["n"]), ["k1", "k2"], "left_anti").select(names)
    if seen["repeated"]:
        again = hashed.join(small(marks.where("_stays").select("k1", "k2"), seen["repeated"]), ["k1", "k2"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["k1", "k2"]).select(names))
    return out.toDF(*docs.columns)
