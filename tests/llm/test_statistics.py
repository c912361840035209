"""Whitening, fingerprints and collocations against plain Python."""

import base64
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from stallmark.llm import fingerprints, phrases, whitening

VECTORS = "vec_id long, embedding array<float>, n string, component string"


def exact_whitening(rows, components=8):
    """{(id, component): (n, deviation, explained)} and, up to the sign, whitened values."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(dim)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    out = {}
    for i, (key, _) in enumerate(rows):
        deviation = sum((n * x[i][j] - sums[j]) ** 2 for j in range(dim))
        for c in range(min(components, dim)):
            out[key, c + 1] = (n, deviation, values[c] / values.sum(), centred[i] @ axes[:, c] / np.sqrt(values[c]))
    return out


def test_whitening_against_plain_numbers(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(1, 3, 10)
    rows = [(i, (rng.normal(size=10) * scale).astype(np.float32).tolist()) for i in range(300)]
    odd = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, [1.0] * 3), (905, [])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + odd], VECTORS).repartition(40)
    got = whitening.whiten(df, fan_in=3).collect()
    want = exact_whitening(rows)
    assert len(got) == len(want) == 2400 and {(r.vec_id, r.component) for r in got} == set(want)
    sign = {c: np.sign(sum(r.whitened * want[r.vec_id, c][3] for r in got if r.component == c)) for c in range(1, 9)}
    for r in got:
        n, deviation, explained, white = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.explained - explained) < 1e-9 and abs(r.whitened - sign[r.component] * white) < 1e-7
        assert r.identity_error < 1e-9
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component)) if r.component == c] for c in range(1, 9)])
    assert np.abs(np.cov(w, bias=True) - np.eye(8)).max() < 1e-9


def test_squares_are_exact_beyond_64_bits():
    d = np.array([[(1 << 61) - 7, -(1 << 60) + 3], [5, -1], [0, 0]])
    assert whitening._squares(d) == [sum(int(x) ** 2 for x in row) for row in d]
    assert whitening._squares(d.astype(object)) == [sum(int(x) ** 2 for x in row) for row in d]
    assert whitening._centred(np.array([[1 << 50]]), 1 << 20, [3]).tolist() == [[(1 << 70) - 3]]


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "", "")], VECTORS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], "", "")], VECTORS)).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 1, 0, None, 0.0, None) for c in (1, 2)]
    line = [(1, [0.0, 0.0], "", ""), (1, [0.0, 0.0], "", ""), (2, [1.0, 1.0], "", "")]  # repeated rows, one direction without variance
    got = sorted(whitening.whiten(spark.createDataFrame(line, VECTORS)).collect(), key=lambda r: (r.component, r.vec_id))
    assert [abs(round(r.whitened, 6)) for r in got[:3]] == [0.707107, 0.707107, 1.414214] and all(r.whitened is None for r in got[3:])
    assert got[0].identity_error < 1e-9 and got[0].explained == 1.0
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], "", "")], VECTORS)).collect()


DOCS = "doc_id long, text string, lang string, part string, n_chars string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_neighbours(rows):
    """(id, n_chars, edited) in order, for distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        m = len(text) // 3
        out.append((key, len(text), text[: len(text) - m] + after[:m]))
    return out


def test_neighbours_against_plain_python(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"wé{i}" if i % 3 else f"𝒳{i}" for i in range(4000)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(int(i) * 7 - 300, make(int(n))) for i, n in enumerate(rng.integers(1, 900, 120))]
    rows += [(None, make(40)), (10_001, None), (10_002, ""), (10_003, "..."), (10_004, make(60_000)), (10_005, rows[3][1]), (10_006, "one two")]
    df = spark.createDataFrame([(i, t, "x", "p", "n") for i, t in rows], DOCS).repartition(5)
    whole = fingerprints.neighbours(df, parts=9, fraction=1.0).collect()
    by_id = {r.doc_id: r for r in whole}
    for key, n, edited in plain_neighbours(rows):
        r, text = by_id[key], dict(rows)[key] or ""
        assert (r.n_chars, r.edited) == (n, edited)
        a, b = shingles(text), shingles(edited)
        assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.held_edited == pytest.approx(len(a & b) / len(a) if a else 1.0)
    assert len(whole) == len(rows) and by_id[10_005].fingerprint == by_id[rows[3][0]].fingerprint
    some = {r.doc_id: r for r in fingerprints.neighbours(df, parts=2).collect()}
    assert some.keys() == by_id.keys() and all(some[k].edited == by_id[k].edited for k in some)
    large = [k for k in some if by_id[k].n_chars > 3000]
    assert np.mean([abs(some[k].near_edited - by_id[k].near_edited) for k in large]) < 0.06
    assert abs(some[10_004].held_edited - by_id[10_004].held_edited) < 0.02
    for k in large:  # what is kept is the low part of the whole
        full, kept = (set(re.findall(".{8}", x[k].fingerprint)) for x in (by_id, some))
        assert kept == {c for c in full if base64.b64decode(c) < (1 << 45).to_bytes(6, "big")}


def test_neighbours_of_odd_tables(spark):
    assert fingerprints.neighbours(spark.createDataFrame([], DOCS)).collect() == []
    one = fingerprints.neighbours(spark.createDataFrame([(1, "abcdef ghi", "", "", "")], DOCS)).collect()[0]
    assert (one.edited, one.near_next, one.held_next) == ("abcdef abc", 1.0, 1.0)
    same = [(5, "a b c d e f", "", "", "")] * 400 + [(None, f"null id {i} with its own words", "", "", "") for i in range(200)] + [(4, "z", "", "", "")]
    got = fingerprints.neighbours(spark.createDataFrame(same, DOCS).repartition(7), parts=6).collect()
    assert len(got) == 601 and sum(r.near_next == 1.0 for r in got if r.doc_id == 5) == 399 and sum(r.doc_id is None for r in got) == 200
    with pytest.raises(TypeError):
        fingerprints.neighbours(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sketches_merge_and_contain(spark):
    rng = np.random.default_rng(8)
    long = [f"w{i}" for i in rng.integers(0, 50_000, 30_000)]
    texts = [(1, " ".join(long)), (2, " ".join(long[1000:1800])), (3, " ".join(long[:15_004])), (4, " ".join(long[15_000:])), (5, "tiny")]
    own = fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    assert own.columns == ["doc_id", "n_chars", "fingerprint"]
    prints = {r.doc_id: r.fingerprint for r in own.collect()}
    pair = spark.createDataFrame([(prints[2], prints[1])], "a string, b string").select(fingerprints.containment("a", "b").alias("in"), fingerprints.containment("b", "a").alias("of"), fingerprints.jaccard("a", "b").alias("near")).first()
    assert pair["in"] == 1.0 and abs(pair["of"] - 796 / 29_996) < 0.02 and pair["near"] < 0.05
    merged = fingerprints.merge_codes(own.where("doc_id in (3, 4)").selectExpr("1 as g", "fingerprint"), ["g"], "fingerprint").first().fingerprint
    assert merged == prints[1] and len(prints[5]) == 8


ODD = ["a b c a b c a b c", "A\tB  c.a b: c", None, "", " . , ", "a\nb c", "ü ü ü ü ü!ü ü", "q" * 3000 + " a b", "x y z w x y z w x y z w", "a b c a b c a b c"]


def plain_collocations(rows, least, longest, top):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + m] for p, a in good.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        found = []
        for p, a in good.items():
            if p not in covered:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top"), [(2, 4, 2000), (1, 4, 5), (3, 2, 2000)])
def test_collocations_against_plain_python(spark, least, longest, top):
    rng = np.random.default_rng(1)
    rows = [("en" if i % 3 else None, t) for i, t in enumerate(ODD * 2)] + [("en", " ".join(rng.choice(list("abcdé"), int(n)))) for n in rng.integers(1, 60, 80)]
    df = spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, phrase int").repartition(6)
    got = phrases.collocations(df, least=least, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, longest, top)


def test_collocations_of_an_empty_table_and_a_long_text(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []
    long = "lorem ipsum dolor " * 200_000
    got = phrases.collocations(spark.createDataFrame([(long, "la")], "text string, lang string")).collect()
    assert [(r.phrase, r.a, r.n) for r in got] == [("dolor lorem ipsum dolor", 199_999, 600_000), ("ipsum dolor lorem ipsum", 199_999, 600_000), ("lorem ipsum dolor lorem", 199_999, 600_000)]


def test_full_tables_flush_their_sums(spark, monkeypatch):
    rows = [("en", " ".join(f"w{i % 97} x{i % 89} y{i % 13}" for i in range(3000)))] * 3
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").coalesce(1)
    want = plain_collocations(rows, 30, 4, 2000)
    sums = phrases._Sums()
    rng = np.random.default_rng(0)
    monkeypatch.setattr(phrases, "HELD", 50)
    seen = Counter()
    for _ in range(40):
        key = rng.integers(0, 300, 40).astype(np.uint64)
        sums.add(*phrases.lists(key)[:2])
        seen.update(key.tolist())
        sums.full()
    got = {k: c for b in sums.batches() for k, c in zip(b.column("key").to_pylist(), b.column("c").to_pylist(), strict=True)}
    assert got == dict(seen)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == want


def test_word_hashes_follow_the_words_alone():
    text = b"ab abcdefgh abcdefghi ab " + b"z" * 700 + b" abcdefgh " + b"z" * 700 + b" " + b"z" * 701
    found = [(m.start(), m.end() - m.start()) for m in re.finditer(rb"[^ ]+", text)]
    data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(8, np.uint8)])
    start, length = (np.array(x) for x in zip(*found, strict=True))
    hashes = phrases.word_hashes(data, start, length).tolist()
    by_word = {}
    for (s, n), h in zip(found, hashes, strict=True):
        by_word.setdefault(text[s : s + n], set()).add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len(set(hashes)) == len(by_word)
