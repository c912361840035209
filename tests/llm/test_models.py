"""Classifiers, URL reputation, quotations and the pipeline."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stallmark.llm import language, quotations, toxicity, training, url_reputation
from stallmark.llm.queries import QUERIES, URL_RULES


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    parts = {"en": ["th", "er", "on", "ing", "wh"], "de": ["sch", "ei", "ung", "ver", "ß"], "fr": ["eau", "é", "elle", "ç", "que"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        text = [word(lang) for _ in range(rng.choice([4, 40, 150]))]
        toxic = rng.random() < 0.3
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(text), lang, int(toxic)))
    return rows


def test_language(spark, prose):
    df = spark.createDataFrame([(i, t, g) for i, t, g, _ in prose], "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 -- 34", "en"), (-4, "THE WHERING " * 20000, "de")], df.schema)
    got = {r.doc_id: r for r in language.identify(df.unionByName(odd).withColumn("score", F.lit("clash")), model).collect()}
    held = [(i, g) for i, _, g, _ in prose if i % 4 == 2]
    assert sum(got[i].lang_pred == g for i, g in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (-1, -2, -3))
    assert got[-4].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    sure = [got[i].lang_pred == g for i, g in held if got[i].accepted]
    assert sum(sure) >= 0.97 * len(sure) > 0


def test_language_does_not_depend_on_neighbours(prose):
    model = language.train([t for _, t, _, _ in prose], [g for _, _, g, _ in prose], epochs=1)
    texts = [t for _, t, _, _ in prose[:50]]
    together = model.probabilities(texts)[0]
    assert all((model.probabilities([t])[0][0] == together[i]).all() for i, t in enumerate(texts))


def test_language_without_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.fit(df)).first().lang_pred == "und"


def test_toxicity(spark, prose):
    df = spark.createDataFrame([(i, t, g) for i, t, g, _ in prose], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in prose], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.where("doc_id % 5 <> 0"))
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "the where " * 20000 + " scum", "en")], df.schema)
    got = {r.doc_id: r for r in toxicity.score(df.unionByName(odd), model).collect()}
    held = [(i, y) for i, _, _, y in prose if i % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[-1].score == got[-2].score and got[-3].predicted == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = toxicity.keep_harmless(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if i >= 0 and not r.predicted}
    one = toxicity.fit(df, labels.where("toxic = 0"))
    assert toxicity.score(df, one).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_learns_from_all_texts(spark):
    """A word that only one text in a hundred has, among more texts than a sample took, and one behind 256 KB are learnt; shards do not depend on partitions."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(8)) + (" idiot" if i % 2 else ""), i % 2) for i in range(4000)]
    rows += [(5000 + i, "zz " * 90_000 + ("vermin" if i % 2 else "fine"), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("lang", F.lit("en"))
    parts, counts, n = training.learnt(df, df.select("doc_id", "toxic"), doc_id="doc_id", text="text", label="toxic", shard_bytes=2 << 20)
    assert counts == {"0": 2020, "1": 2020} and n > 3
    again, _, _ = training.learnt(df.repartition(7), df.select("doc_id", "toxic"), doc_id="doc_id", text="text", label="toxic", shard_bytes=2 << 20)
    assert {(r.shard, r.h) for r in parts.select("shard", "h").collect()} == {(r.shard, r.h) for r in again.select("shard", "h").collect()}
    model = toxicity.fit(df, df.select("doc_id", "toxic"), shard_bytes=2 << 20)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.97 * len(rows)
    assert sum(got[i] == y for i, _, y in rows[4000:]) >= 36


def letters_of(text):
    """Lower-cased letters as numbers, a 0 for each run of others and in front."""
    out = [0]
    for c in (text or "").lower():
        if c.isalpha():
            out.append(ord(c))
        elif out[-1]:
            out.append(0)
    return out if not out[-1] else [*out, 0]


def plain_language(model, text):
    """The forward pass of the language model, one subword after the other."""
    code, total, n = letters_of(text), [0.0] * len(model.languages), 0
    for i in range(len(code)):
        for size in language.SIZES:
            part = code[i : i + size]
            if len(part) < size or any(c == 0 for c in part[1:-1]):
                continue
            h = 0
            for k, c in enumerate(part):
                h = c if k == 0 else (h * 0x9E3779B1 + c) % 2**32
            g = (h ^ h >> 15) * 0x85EBCA6B % 2**32
            g = (g ^ g >> 13) * 0xC2B2AE35 % 2**32
            bucket = g >> 32 - language.BITS
            n += 1
            total = [t + float(x) for t, x in zip(total, model.table[bucket].astype("float32"), strict=True)]
    z = [(t / max(n, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_language_by_a_plain_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    rows = docs.select("doc_id", "text").collect() + [(-1, "Ab, cd--E", None), (-2, "é", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), model).collect()}
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            p = plain_language(model, r[1])
            assert got[r[0]].lang_pred == model.languages[p.index(max(p))] and abs(got[r[0]].score - max(p)) < 1e-4
            assert got[r[0]].accepted == (max(p) >= model.floor) or abs(max(p) - model.floor) < 1e-4
        else:
            assert got[r[0]].lang_pred == "und" and got[r[0]].score == 0


def plain_logit(model, text, vectors):
    """The forward pass of the toxicity model, one window after the other."""
    import numpy as np
    import pyarrow as pa

    from stallmark.llm.text import Words
    from tests.llm.test_texts import words

    seen = words(text)
    for w in seen:
        if w not in vectors:
            rows, _ = toxicity.word_buckets(Words(pa.array([w])))
            vectors[w] = model.E[rows[0]].astype("float64").sum(0)
    pooled = []
    for k in toxicity.WIDTHS:
        best = np.zeros(toxicity.FILTERS)
        for i in range(len(seen)):
            h = model.b[k].astype("float64")
            for j in range(min(k, len(seen) - i)):  # behind the last word there is nothing
                h = h + vectors[seen[i + j]] @ model.W[k, j].astype("float64")
            best = np.maximum(best, h)
        pooled.append(best)
    return float(np.concatenate(pooled) @ model.v.astype("float64") + model.c[0])


def test_toxicity_by_a_plain_forward_pass(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows, vectors = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-1, None), (-2, "--")], {}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        tongue = int(model.languages.predict([text])[0])
        z = model.slope * (plain_logit(model, text, vectors) - model.threshold.get(tongue, model.threshold[-1]))
        score = 1 / (1 + math.exp(-max(-500, min(500, z))))
        assert abs(got[i].score - score) < 1e-4 and got[i].predicted == (got[i].score >= 0.5)


def test_models_of_odd_tables(spark, prose):
    rows = [(i, t, g) for i, t, g, _ in prose[:60]]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, "x y", "en"), (7, None, None)], "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "predicted": F.lit("x")})
    none = spark.createDataFrame([], "doc_id long, toxic int")
    models = language.fit(df), toxicity.fit(df, none)
    for out in (language.identify(df, models[0]), toxicity.score(df, models[1])):
        got = out.collect()
        assert len(got) == 64 and len({tuple(r) for r in got if r.doc_id == rows[0][0]}) == 1
    assert {r.predicted for r in toxicity.score(df, models[1]).collect()} == {0}
    assert language.identify(df.where("false"), models[0]).count() == toxicity.score(df.where("false"), models[1]).count() == 0
    assert language.identify(df, language.fit(df.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_many_rules_and_odd_pages(spark):
    rules = [("block" if k % 2 else "allow", f"h{k}.net", "/") for k in range(12_000)] + [("allow", "net", "/x"), ("block", "net", "/x"), ("block", "h1.net", "/"), ("allow", "h1.net", "/")]
    long = "https://h3.net/" + "a" * 100_000
    pages = spark.createDataFrame([(1, "https://a.h2.net/x", "q"), (1, "https://a.h2.net/x", "q"), (None, "https://h1.net/", "q"), (3, long, "q"), (4, "https://net/x", None), (5, None, None), (6, "https://h2.netx/", "")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "host string, good int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.judge(pages, rules, none).collect()}
    assert got == {1: ("h2.net/", "allow"), None: ("h1.net/", "block"), 3: ("h3.net/", "block"), 4: ("net/x", "block"), 5: (None, "allow"), 6: (None, "allow")}
    assert url_reputation.judge(pages, rules, none).count() == 7 and url_reputation.judge(pages.where("false"), rules, none).count() == 0 and url_reputation.judge(pages, [], none).where("rule is null").count() == 7


def test_urls(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "ftp://m.example.com/fr/", "x://example.com", "x://example.com/de/5", "nothing", None, "http://notexample.org2/de/", "a://b://c/d", "http://sub.example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, good int")
    got = {r.page_id: r for r in url_reputation.judge(pages, URL_RULES, none).collect()}
    assert [(got[i].host, got[i].path) for i in range(10)] == [("a.example.org", "/es/1"), ("example.org", "/en/12"), ("m.example.com", "/fr/"), ("example.com", ""), ("example.com", "/de/5"), ("", ""), ("", ""), ("notexample.org2", "/de/"), ("b:", "//c/d"), ("sub.example.org", "/en/2")]
    assert [got[i].rule for i in range(10)] == ["example.org/es/", "example.org/en/1", "com/fr/", None, "com/de/", None, None, None, None, "org/"]
    assert [got[i].verdict for i in range(10)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow"]


def test_reputation(spark):
    rng = random.Random(1)
    rows = []
    for d in range(12):
        base = 0.95 if d % 2 else 0.3
        rows += [(f"h{h}.d{d}.net", int(rng.random() < base)) for h in range(4) for _ in range(30)]
    rows += [(None, 1), ("x.net", None)]
    hosts = spark.createDataFrame([(h,) for h in sorted({h for h, _ in rows if h}) + ["new.d0.net", "new.d1.net", "other.org", ""]], "host string")
    got = {r.host: r for r in url_reputation.reputation(hosts, spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["h1.d1.net"].good and not got["h1.d0.net"].good
    assert got["new.d1.net"].rate > got["other.org"].rate > got["new.d0.net"].rate  # strangers lean to their domain
    for h in ("h0.d0.net", "h3.d5.net"):
        own = [g for x, g in rows if x == h]
        mean, domain = sum(own) / len(own), got[f"new.{h.split('.')[1]}.net"].rate if f"new.{h.split('.')[1]}.net" in got else None
        assert got[h].bound < got[h].rate and (domain is None or min(mean, domain) - 0.1 <= got[h].rate <= max(mean, domain) + 0.1)


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"),
        (1, 1, "b", "Fine.\nAnd you?"),
        (1, 2, "a", "On Monday b wrote:\n> Fine.\n> > How are you?\nGood"),
        (1, 3, "c", ">  hello   THERE.\nme too\n> never said"),
        (1, 4, "c", "> And you?"),
        (2, 0, "a", "> Fine."),
        (2, 1, "b", None),
        (2, 2, "b", ""),
        (None, 5, "a", "> Fine."),
        (2, 0, "a", "> Fine."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotations.replies(df).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 2].text == "Good" and (got[1, 2].parent, got[1, 2].level, got[1, 2].n_quoted, got[1, 2].n_linked) == (1, 2, 2, 2)
    assert (got[1, 3].parent, got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].text) == (0, 2, 1, "me too")
    assert (got[1, 4].parent, got[1, 4].text) == (1, "")
    assert got[2, 0].parent is None and got[2, 0].n_linked == 0 and got[2, 1].text == ""
    order = [r.turn for r in quotations.conversations(df.where("conv_id = 1")).collect()]
    assert order == [0, 3, 1, 2, 4] and math.prod(order.index(p) < order.index(t) for t, p in ((2, 1), (3, 0), (4, 1)))
    assert [got[1, t].position for t in order] == [1, 2, 3, 4, 5] and sorted(r.position for r in out if r.conv_id == 2) == [1, 2, 3, 4] and got[None, 5].position is None


LONG = "The first sentence is about the weather in the north of the country. Is the second one a question about ships? The third one has no end"


def wrapped(text, width, mark):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(mark + x for x in [*lines, line])


def quoted_messages():
    rows = [(1, 0, "a", LONG), (1, 1, "b", "Another message. Is the second one a question about ships?\nA line of its own\nand another")]
    rows += [(1, 2 + k, "c", f"On Monday a wrote:\n{wrapped(LONG, width, mark)}\nYes, indeed.") for k, (width, mark) in enumerate([(72, "> "), (30, ">"), (25, "> > "), (500, ">> ")])]
    rows += [(1, 6, "d", "> Is the second one a question about ships?\nNo."), (1, 7, "d", "> A line of its own\n\n> and another"), (1, 8, "d", "> A line of its own\n> and another"), (1, 9, "d", "> about the weather in the north")]
    rows += [(1, 10, "e", "> yes, INDEED.\n> > The third one has\n> > no end\n\n> never said! nor this"), (2, 0, "a", None), (2, 1, "a", "On Friday b wrote:"), (2, 2, "b", "> " * 40 + "deep"), (None, 1, "a", "> x"), (3, None, "a", "> x")]
    return rows


def test_rewrapped_and_partial_quotations(spark):
    df = spark.createDataFrame(quoted_messages(), "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in quotations.replies(df).collect()}
    assert len(got) == df.count()
    for t, level in ((2, 1), (3, 1), (4, 2), (5, 2)):
        assert (got[1, t].text, got[1, t].parent, got[1, t].level, got[1, t].n_quoted, got[1, t].n_linked) == ("Yes, indeed.", 0, level, 3, 3)
    assert (got[1, 6].parent, got[1, 6].n_linked) == (0, 1)  # the first message that has it
    assert (got[1, 7].parent, got[1, 7].n_quoted, got[1, 7].n_linked) == (1, 2, 2)
    assert (got[1, 8].parent, got[1, 8].n_quoted, got[1, 8].n_linked) == (1, 1, 1)  # both lines make one sentence, on either side
    assert (got[1, 9].parent, got[1, 9].n_linked) == (None, 0)
    assert (got[1, 10].parent, got[1, 10].level, got[1, 10].n_quoted, got[1, 10].n_linked, got[1, 10].text) == (2, 2, 4, 2, "")
    assert got[2, 1].text == "" and got[2, 2].level == 40 and got[None, 1].position is None and got[3, None].position is None
    assert quotations.replies(df.where("false")).count() == 0


def threads():
    """Conversation 50: 6 replies to 5, 5 and 7 to 1, 3 to 2; conversation 51: each of 40 messages replies to the one before; 52: each to one of the first."""
    says = lambda t, p: f"> sentence {p}\nsentence {t}" if p is not None else f"sentence {t}"
    small = [(50, t, "a", says(t, p)) for t, p in {1: None, 2: None, 3: 2, 4: None, 5: 1, 6: 5, 7: 1}.items()]
    chain = [(51, t, "a", says(t, t - 1 if t else None)) for t in range(40)]
    rng = random.Random(3)
    return small + chain + [(52, t, "b", says(t, rng.randrange(t // 2 + 1) if t > 2 else None)) for t in range(60)]


def test_quotations_of_very_long_messages(spark):
    passages = [f"Passage number {i} of the long message." for i in range(3000)]
    quoting = "\n".join(f"> {p}\nanswer {i}" if i % 2 else f"> {p}\n> > unheard of {i}" for i, p in enumerate(passages))
    rows = [(1, 0, "a", "\n\n".join(passages), "x"), (1, 1, "b", quoting, "x"), (1, 2, "c", "w" * 1_000_000, "x"), (1, 3, "d", "> " + "w" * 1_000_000, "x")]
    got = {r.turn: r for r in quotations.replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent string")).collect()}
    assert (got[1].parent, got[1].n_linked, got[1].level) == (0, 3000, 2) and got[1].n_quoted == 4500
    assert got[1].text.split() == " ".join(f"answer {i}" for i in range(1, 3000, 2)).split()
    assert (got[3].parent, got[3].n_quoted, got[3].n_linked, got[3].text) == (2, 1, 1, "") and [got[t].position for t in range(4)] == [1, 2, 3, 4]


def test_threads_stay_together(spark):
    df = spark.createDataFrame(threads() + threads()[:3], "conv_id long, turn long, role string, text string")
    out = quotations.replies(df.repartition(7)).orderBy("conv_id", "position").collect()
    small = [(r.turn, r.thread) for r in out if r.conv_id == 50]
    assert small == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 1), (2, 2), (2, 2), (3, 2), (3, 2), (4, 4)]
    assert [(r.turn, r.thread, r.position) for r in out if r.conv_id == 51] == [(t, 0, t + 1) for t in range(40)]
    parents = {r.turn: r.parent for r in out if r.conv_id == 52}

    def walk(t):
        return [t, *(x for child in sorted(c for c, p in parents.items() if p == t) for x in walk(child))]

    assert [r.turn for r in out if r.conv_id == 52] == [x for t, p in sorted(parents.items()) if p is None for x in walk(t)]


def test_quotations_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from stallmark.llm.sql import OP8

    rng = random.Random(5)
    said = ["Yes.", "no", "Maybe so. Or not?", "a b c", "Long words! in\nlines", ""]
    rows = quoted_messages() + threads() + [(10 + c, t, rng.choice("ab"), "\n".join(rng.choice(["", "> ", ">> ", "> "]) + rng.choice(said) for _ in range(rng.randrange(5)))) for c in range(12) for t in range(rng.randrange(9))]
    df = spark.createDataFrame(rows + rows[:4], "conv_id long, turn long, role string, text string")
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    db = duckdb.connect()
    db.register("conversations", conversations)
    want = db.execute(OP8)
    names = [d[0] for d in want.description]
    got = quotations.replies(df.repartition(5)).select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, sf_dir, name):
    from tests.llm.tables import COUNTS

    out = QUERIES[name](spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/{COUNTS[name]}.parquet").count()
