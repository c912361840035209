"""Near-duplicates of texts and vectors against brute force, small blocks included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallmark.llm import groups, lattice, near_duplicates
from tests.llm.test_texts import STRUCTURED, WORD


def classes(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold]
    n = [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return classes(len(texts), links), n


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [out[0]] * 6 + [out[3].upper() + "!"] + ["", None, "--", "one two", "one two", "ONE two", " ".join(word() for _ in range(20000))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [8, 512])
def test_near_duplicates(spark, texts, block):
    df = spark.createDataFrame([(3 * i + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, block=block).collect()}
    root, n = brute_jaccard(texts)
    assert [got[3 * i + 1].n_links for i in range(len(texts))] == n
    assert [got[3 * i + 1].class_id for i in range(len(texts))] == [3 * r + 1 for r in root]
    left = near_duplicates.drop_near_duplicates(df, block=block)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({3 * r + 1 for r in root})


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in near_duplicates.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, None, 0, True), (2, 2, 0, True), (None, None, 0, True)], key=str)
    assert near_duplicates.near_duplicates(df.where("false")).count() == 0
    with pytest.raises(TypeError):
        near_duplicates.near_duplicates(df.withColumn("doc_id", F.lit("x")))


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    near, far = list(base), list(base)
    near[1000:11000] = ["v"] * 10_000
    far[:150_000] = [f"u{i}" for i in range(150_000)]
    texts = [" ".join(x) for x in (base, near, far)] + ["word " * 500_000, "WORD, " * 400_000, "x" * 3_000_000]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, component string, id int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_one_row_of_each_class_stays(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(4, a, 1), (4, a, 2), (4, b, 3), (2, b, 4), (4, c, 5), (None, a, 6), (None, a, 7), (9, None, 8), (9, None, 9), (7, "A b c d e, f", 10), (3, a, 11), (3, a, 12)]
    left = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3))
    assert left.columns == ["doc_id", "text", "n"]
    got = left.collect()
    assert sorted(r.n for r in got if r.n not in (11, 12)) == [4, 5, 6, 7, 8, 9] and len(got) == 7
    again = spark.createDataFrame([(1, a), (1, a), (1, a)], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates.drop_near_duplicates(again).collect()] == [(1, a)]


def test_structured_words_do_not_link(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(STRUCTURED)], "doc_id long, text string")
    assert {r.n_links for r in near_duplicates.near_duplicates(df).collect()} == {0}


def test_shortest_prefix():
    d = near_duplicates.shortest_prefix(0.8, 0.999, 20, 8)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 20
    k = near_duplicates.sketch_floor(0.8)
    assert sum(math.comb(32, i) * 0.8**i * 0.2 ** (32 - i) for i in range(k)) <= 2e-5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r.id: r.component for r in groups.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {x: i for i, x in enumerate(nodes)}
    root = classes(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert got == {x: nodes[root[place[x]]] for x in nodes}
    assert groups.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_of_any_mixture(spark):
    """Whole cells of near copies, of several groups, and of rows that are not alike give the components of all pairs."""
    rng = np.random.default_rng(4)
    rows, ids = [], 0
    for key, sizes in ((1, [70, 20, 9]), (2, [1] * 40), (3, [60]), (4, [5]), (5, [30, 30])):
        for size in sizes:
            at = rng.integers(0, 256, 8)
            for _ in range(size):  # a walk: neighbours are alike, ends are not
                at = at.copy()
                at[rng.integers(0, 8)] = rng.integers(0, 256)
                rows.append((key, ids, at.astype(np.uint8).tobytes()))
                ids += 1
    rows += [(6, i, r[2]) for i, r in enumerate([r for r in rows if r[0] in (2, 4)][:30], 40)]

    def alike(a, b, outer):
        return ((a[:, None] == b[None]).sum(2) if outer else (a == b).sum(1)) >= 6

    links = []
    for key in range(1, 7):
        own = [(i, np.frombuffer(s, np.uint8)) for k, i, s in rows if k == key]
        links += [(i, j) for i, a in own for j, b in own if j < i and (a == b).sum() >= 6]
    root = classes(ids, links)
    df = spark.createDataFrame([(k, i, bytearray(s)) for k, i, s in rows], "key long, id long, sketch binary").repartition(5)
    for block in (4, 16, 512):
        edges = groups.cell_edges(df, alike, 8, block)
        assert all(root[r.a] == root[r.b] for r in edges.collect())
        found = {r.id: r.component for r in groups.connected_components(edges).collect()}
        assert [found.get(i, i) for i in range(ids)] == root
    assert groups.cell_edges(df.where("false"), alike, 8).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_recall_within_large_nodes(spark, block):
    """Pairs at the threshold whose texts all share a template, so that a node holds many others too."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for p in range(150):
        own = template + [f"p{p}x{i}" for i in range(90)]
        for side in "ab":
            tail = [f"{side}{p}y{i}" for i in range(21)]
            texts.append(" ".join(own + tail))
    close = [len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    far = len(shingle_set(texts[0]) & shingle_set(texts[2])) / len(shingle_set(texts[0]) | shingle_set(texts[2]))
    assert all(0.8 <= x < 0.85 for x in close) and 0.35 < far < 0.5
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(df, block=block).collect()}
    assert sum(got[i] == got[i + 1] == (i, 1) for i in range(0, len(texts), 2)) >= 0.99 * len(close)
    assert all(got[i][0] // 2 == i // 2 for i in got)


def test_e8():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8)) * 2
    p = lattice.e8(x)
    twice = np.round(2 * p)
    assert np.allclose(2 * p, twice) and (np.ptp(twice % 2, axis=1) == 0).all() and np.allclose(p.sum(1) % 2, 0)
    assert np.sqrt(((x - p) ** 2).sum(1)).max() <= 1 + 1e-9  # the covering radius
    steps, far = lattice.e8_neighbours(x, p)
    for s, f in zip(steps, far, strict=True):
        assert np.allclose((s * s).sum(1), 2) and np.allclose(((x - p - s) ** 2).sum(1) - ((x - p) ** 2).sum(1), f)
        q = np.round(2 * (p + s))
        assert (np.ptp(q % 2, axis=1) == 0).all() and np.allclose((p + s).sum(1) % 2, 0)


@pytest.mark.parametrize("block", [8, 512])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        base = rng.normal(size=32)
        for _ in range(rng.choice([1, 2, 6, 20])):
            rows.append([float(v) for v in np.float32(base + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.33]))])
    rows += [rows[0]] * 4 + [[2 * v for v in rows[5]], None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + rows[1][1:], [None] + rows[1][1:], rows[2][:16], [1e-42] * 32]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in lattice.embedding_links(df, block=block).collect()}
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.float32(rows[i]).astype(float) for i in good}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in unit.items()}
    links = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= n[i] for i in range(len(rows))) and found >= 0.97 * sum(n) > 100
    root = classes(len(rows), links)
    assert sum(got[i].component_id == root[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert lattice.embedding_links(df.where("false")).count() == 0


def test_embeddings_with_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.0, 0.21]), (3, [0.01, 1.0, 0.0]), (3, [0.01, 1.0, 0.0]), (None, a), (5, c), (5, None)]
    out = lattice.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None)
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (5, 0, 5), (5, 0, 5)] and len(out) == 8


def near_copies(n, length, edits, seed):
    """n different texts of about this similarity: one text with some words changed in each."""
    rng = random.Random(seed)
    base = [f"{rng.randrange(10**6):06d}" for _ in range(length)]
    out = []
    for k in range(n):
        copy = list(base)
        for j in range(edits):
            copy[rng.randrange(length)] = f"edit{seed}x{k}x{j}"
        out.append(" ".join(copy))
    return out


def test_recall_at_the_threshold(spark):
    """Pairs with a Jaccard index just over 0.8: all but one in a hundred at least are linked."""
    rng = random.Random(7)
    rows, pairs = [], []
    for i in range(600):
        a = [f"{rng.randrange(10**7):07d}" for _ in range(300)]
        b = list(a)
        for at in range(0, 300, 50):
            b[at + 5 + rng.randrange(40)] = "changed"
        x, y = " ".join(a), " ".join(b)
        sets = shingle_set(x), shingle_set(y)
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.83
        rows += [(2 * i, x), (2 * i + 1, y)]
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[b].class_id == a and got[a].n_links == 1 for a, b in pairs)
    assert found >= 0.99 * len(pairs), found


@pytest.mark.parametrize(("trees", "block"), [(1, 512), (1, 3), (20, 3)])
def test_no_link_is_lost(spark, trees, block):
    """What one trie or large nodes miss is found all the same: pairs at the threshold, with a template and without, short texts too."""
    rng = random.Random(11)
    template, texts = [f"t{i}" for i in range(60)], []
    for p in range(120):
        own = (template if p % 2 else []) + [f"p{p}x{i}" for i in range(rng.choice([9, 40, 120]))]
        texts += [" ".join(own), " ".join(own + [f"y{p}z{i}" for i in range((len(own) - 4) // 4)])]  # n shingles of n + n // 4: 0.8 and just over
    root, n = brute_jaccard(texts)
    assert sum(n) == len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, trees=trees, block=block).collect()}
    assert [got[i].class_id for i in range(len(texts))] == root and [got[i].n_links for i in range(len(texts))] == n


def test_large_groups_by_representatives(spark):
    """Groups of many blocks, loose and tight, with and without counting links, against brute force."""
    tight, loose = near_copies(150, 120, 1, 1), near_copies(60, 60, 2, 2)
    chain = near_copies(1, 80, 0, 3)
    for k in range(40):  # each like the one before, the last unlike the first
        words = chain[-1].split()
        words[2 * k % 80] = f"link{k}"
        chain.append(" ".join(words))
    texts = tight + loose + chain
    random.Random(4).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, n = brute_jaccard(texts)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, block=16).collect()}
    assert [got[i].class_id for i in range(len(texts))] == root and [got[i].n_links for i in range(len(texts))] == n
    left = near_duplicates.drop_near_duplicates(df, block=16)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root))


def test_linked_groups_make_sure_of_the_rest(spark):
    """A component whose blocks' representatives do not link falls into the groups of all its links."""
    rng = random.Random(2)
    place = [(i, i % 3, rng.randrange(10**6)) for i in range(300)]  # three groups in one candidate component
    df = spark.createDataFrame([(7, i, 1, float(g * 1000 + k)) for k, (i, g, _) in enumerate(place)], "component long, id long, weight long, v double")

    def compare(table):
        v = table.column("v").to_numpy()
        return np.abs(v[:, None] - v[None]) <= 7.5

    edges = groups.linked_groups(df.drop("v"), compare, lambda x: x.join(df.select("id", "v"), "id"), block=16)
    got = {r.id: r.component for r in groups.connected_components(edges).collect()}
    values = [float(g * 1000 + k) for k, (_, g, _) in enumerate(place)]
    root = classes(300, [(i, j) for i in range(300) for j in range(i) if abs(values[i] - values[j]) <= 7.5])
    assert [got.get(i, i) for i in range(300)] == root


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    for dim in (16, 64, 256):
        x = rng.normal(size=(1500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = rng.normal(size=x.shape)
        g -= (g * x).sum(1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
        a, b = lattice.cells(x), lattice.cells(y)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.97
