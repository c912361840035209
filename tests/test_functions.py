"""Scalar functions against tables of values."""

import pytest
from pyspark.sql import functions as F

from stallmark.config import ClassificationConfig, MatchConfig
from stallmark.functions import similarity, terms, text
from stallmark.functions.rounding import clamp, fixed, money, money_exact
from stallmark.shared import numbered


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    assert column(spark, ["RTX-4090 Ti!!", "", None, "a a"], text.tokenize) == [["rtx", "4090", "ti"], [], [], ["a", "a"]]


def test_clean_text(spark):
    given = ["“RTX” ​ 4090", "  a\t\nb ", "ﬁne…", None, "", "x  y"]
    assert column(spark, given, text.clean_text) == ['"RTX" 4090', "a b", "fine...", None, "", "x y"]


def test_control_and_symbols(spark):
    assert column(spark, ["a\u0000b\tc‮d"], text.remove_control_characters) == ["ab\tcd"]
    assert column(spark, ["a😀 5€ +b"], text.remove_symbols) == ["a 5€ +b"]


@pytest.mark.parametrize("form,want", [("NFC", "é"), ("NFD", "é"), ("NFKC", "é")])
def test_unicode_forms(spark, form, want):
    assert column(spark, ["é", "plain"], lambda c: text.normalize_unicode(c, form)) == [want, "plain"]


def test_currency(spark):
    given = ["€", " eur ", "Euro", "$", "£", "jpy", "###", "", None, "stg"]
    assert column(spark, given, lambda c: text.currency_code(c, default="usd")) == ["EUR", "EUR", "EUR", "USD", "GBP", "JPY", None, "USD", "USD", "GBP"]
    assert column(spark, ["$", "kr"], lambda c: text.currency_code(c, aliases={"KR": "SEK"})) == [None, "SEK"]


def test_condition(spark):
    given = ["BNIB", "pre-owned", "Second  Hand", "refurb", "renewed", "odd", None, "", "new", "Open Box"]
    assert column(spark, given, text.condition_name) == ["new", "used", "used", "refurbished", "refurbished", "unknown", "unknown", "unknown", "new", "used"]


def test_location(spark):
    given = ["  co. dublin ", "some   town", "", None, "O'brien st-john", "County Cork."]
    assert column(spark, given, text.location_name) == ["Dublin", "Some Town", None, None, "O'Brien St-John", "Cork"]


def test_fingerprint_and_identity(spark):
    import hashlib

    row = spark.sql("select array('b','a','b') t, cast(null as string) c, 'new' n, ' Ebay ' p, ' A  b ' s").select(text.fingerprint(F.col("t"), F.col("c"), F.col("n")).alias("f"), text.identity_key(F.col("p"), F.col("s")).alias("k")).first()
    assert row.f == hashlib.sha256(b"tokens=a b|currency=|condition=new").hexdigest()[:16]
    assert row.k == "ebay|a b"


def test_rounding(spark):
    assert column(spark, [2.344, 2.346, 0.125, -1.0, None], lambda c: money(c), "double") == [2.34, 2.35, 0.13, -1.0, None]
    assert column(spark, [-0.5, 0.25, 3.0], clamp, "double") == [0.0, 0.25, 1.0]
    assert column(spark, [3.0, 2.5], text.plain_number, "double") == ["3", "2.5"]


def test_model_tokens(spark):
    assert column(spark, [["4090", "s24", "512gb", "1", "16", "rtx"]], similarity.model_tokens, "array<string>") == [["4090", "s24", "512gb"]]


PAIRS = [
    (["a", "b"], ["b", "c"], 1 / 3, 0.5),
    (["a", "b"], ["a", "b", "c"], 2 / 3, 1.0),
    ([], [], 0.0, 0.0),
]


@pytest.mark.parametrize("a,b,j,o", PAIRS)
def test_set_similarity(spark, a, b, j, o):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(similarity.jaccard(F.col("a"), F.col("b")).alias("j"), similarity.overlap_coefficient(F.col("a"), F.col("b")).alias("o")).first()
    assert row.j == pytest.approx(j) and row.o == o


def plain_score(a, b, c=MatchConfig()):
    """A pair score by the rules, in plain Python."""
    a, b = set(a) - {""}, set(b) - {""}
    if not a or not b:
        return 0.0
    s = (1 - c.overlap_weight) * len(a & b) / len(a | b) + c.overlap_weight * len(a & b) / min(len(a), len(b))
    models = [{t for t in x if any(map(str.isdigit, t)) and (any(map(str.isalpha, t)) or len(t) > 2)} for x in (a, b)]
    if all(models):
        s = s + (1 - s) * c.shared_model_boost if models[0] & models[1] else min(s, c.model_conflict_cap)
    brands = [x & set(c.brands) for x in (a, b)]
    if all(brands):
        s = s + (1 - s) * c.shared_brand_boost if brands[0] & brands[1] else s * c.brand_conflict_factor
    import math

    return math.floor(max(0.0, min(1.0, s)) * 1e4 + 0.5) / 1e4


def test_pair_scores(spark):
    titles = ["rtx 4090", "rtx 4090 graphics card boxed", "rtx 4080", "nvidia card", "amd card", "apple macbook pro", "apple macbook air", "", "nvidia rtx 4090", "sony tv 55"]
    pairs = [(x.split(), y.split()) for x in titles for y in titles]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    c = MatchConfig()
    scored = rows.select("i", similarity.features(F.col("a"), c).alias("a"), similarity.features(F.col("b"), c).alias("b"))
    out = scored.select("i", similarity.pair_score(F.col("a"), F.col("b"), c).alias("s"), similarity.explain(F.col("a"), F.col("b"), similarity.pair_score(F.col("a"), F.col("b"), c), c).alias("why")).orderBy("i").collect()
    assert [r.s for r in out] == [plain_score(a, b) for a, b in pairs]
    by = {(" ".join(a), " ".join(b)): r for (a, b), r in zip(pairs, out, strict=True)}
    assert by["rtx 4090", "rtx 4080"].s <= 0.30 and "conflicting model identifiers: ['4090'] vs ['4080']" in by["rtx 4090", "rtx 4080"].why
    assert by["rtx 4090", "rtx 4090 graphics card boxed"].s >= c.same_threshold
    assert c.possible_threshold <= by["apple macbook pro", "apple macbook air"].s < c.same_threshold
    assert by["", "rtx 4090"].why == ["one or both listings have no comparable tokens"]


TITLES = [
    ("Zotac GeForce RTX 4090 Trinity", "complete_product", 95),
    ("12VHPWR Cable for RTX 4090", "accessory", 90),
    ("RTX 4090 riser cable", "accessory", 92),
    ("RTX 4090 Fan Replacement", "part", 90),
    ("RTX 4090 Graphics Card empty box", "rejected", 95),
    ("4090 graphics card boxed", "unknown", 45),
    ("garden chair", "rejected", 90),
    ("4090 by rtx", "complete_product", 80),
    ("", "rejected", 90),
    (None, "rejected", 90),
]


def test_classification(spark):
    verdicts = column(spark, [t for t, _, _ in TITLES], lambda c: terms.classify_title(c, "rtx 4090"))
    assert [(v.classification, v.match_confidence) for v in verdicts] == [(k, n) for _, k, n in TITLES]
    free = column(spark, ["anything"], lambda c: terms.classify_title(c, "rtx", ClassificationConfig(required_terms=())))
    assert free[0].match_confidence == 60 and free[0].reason == "No required terms defined"


def test_bad_configurations():
    for bad in ({"same_threshold": 0.2}, {"overlap_weight": 2.0}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)


def test_fixed_places_are_those_of_printf(spark):
    values = [12.25, 0.125, -0.375, 2.675, 1e6 + 0.005, 0.0, -3.0, 99.995, 1234567.891]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x")).alias("two"), fixed(F.col("x"), 1).alias("one"), fixed(F.col("x"), signed=True).alias("signed")).collect()
    assert [(r.two, r.one, r.signed) for r in got] == [(f"{v:.2f}", f"{v:.1f}", f"{v:+.2f}") for v in values]


def test_places_are_those_of_row_number(spark):
    rows = [(g, i * 37 % 101) for g in ("a", None, "b") for i in range(100 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = {(r.g, r.v): r.place for r in numbered(df, "g", [F.col("v").desc()], "place").collect()}
    for g in ("a", None, "b"):
        own = sorted((v for x, v in rows if x == g), reverse=True)
        assert [got[g, v] for v in own] == list(range(1, len(own) + 1))
    assert numbered(df.where("false"), "g", [F.col("v")], "place").count() == 0


def test_exact_rounding_is_pythons(spark):
    got = spark.range(200_001).select((F.col("id") / 1000.0).alias("x")).select("x", money_exact(F.col("x")).alias("y")).toPandas()
    assert (got.y == [round(x, 2) for x in got.x]).all()
