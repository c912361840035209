"""Stages on small tables."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallmark.config import ComparisonConfig, DeduplicationConfig, MatchConfig, NormalizationConfig, OpportunityConfig, PairStrategy, PricingConfig, ScoringConfig
from stallmark.operators import compare, deduplicate, normalize, opportunity, pair_strategies, pricing, ranking
from tests.test_functions import plain_score


def raw(spark, rows):
    return spark.createDataFrame(rows, "title string, currency string, condition string, location string")


def test_normalize_chain(spark):
    df = raw(spark, [("Brand New “RTX”  4090 Card 😀", "€", "BNIB", "co. dublin"), ("", None, None, None)])
    out = normalize.normalize(df, NormalizationConfig(default_currency="usd")).orderBy(F.desc("title")).collect()
    full = next(r for r in out if r.title)
    assert full.n_title == 'brand new "rtx" 4090 card' and full.tokens == ["rtx", "4090", "card"]
    assert (full.n_currency, full.n_condition, full.n_location) == ("EUR", "new", "Dublin")
    empty = next(r for r in out if not r.title)
    assert (empty.tokens, empty.n_currency, empty.n_condition, empty.n_location) == ([], "USD", "unknown", None)


def test_chain_is_editable(spark):
    chain = normalize.default_chain()
    assert chain.names == ["unicode", "text_cleaning", "whitespace", "title_cleanup", "currency", "condition", "location"]
    shout = chain.add("shout", lambda df: df.withColumn("n_title", F.upper("n_title"))).remove("location")
    out = normalize.normalize(raw(spark, [("a b", "eur", "used", "x")]), chain=shout).first()
    assert out.n_title == "A B" and out.n_location == "x"
    with pytest.raises(KeyError):
        chain.remove("nothing")
    with pytest.raises(ValueError):
        normalize.Chain([("", lambda df: df)])


def test_alias_registration():
    c = NormalizationConfig().with_alias("currency", "Kr", "sek")
    assert c.currency_aliases["kr"] == "SEK" and c.currency_aliases["$"] == "USD"


def greedy(rows, config):
    """Sequential grouping in plain Python: (listing_id, provider) of the leader of each row."""
    leaders, out = [], {}
    for i, p, o, t in sorted(rows):
        for key, tokens in leaders:
            s = plain_score(tokens, t, config.match_config)
            if s >= (config.match_config.possible_threshold if config.include_possible_matches else config.match_config.same_threshold):
                out[i, p, o] = key
                break
        else:
            leaders.append(((i, p, o), t))
            out[i, p, o] = (i, p, o)
    return out


@pytest.mark.parametrize("possible", [False, True])
def test_grouping_is_the_sequential_one(spark, possible):
    rng = random.Random(3)
    words = ["rtx", "4090", "4080", "card", "nvidia", "amd", "ti", "pro", "boxed", "512gb", "x"]
    config = DeduplicationConfig(include_possible_matches=possible)
    rows = [(q, f"l{rng.randrange(60):02d}", rng.choice("ab"), k, [rng.choice(words) for _ in range(rng.randrange(5))]) for q in ("q1", "q2") for k in range(80)]
    df = spark.createDataFrame(rows, "query string, listing_id string, provider string, ordinal long, tokens array<string>")
    for first, growth in ((5, 2), (64, 16)):
        got = {(r.query, r.listing_id, r.provider, r.ordinal): tuple(r.leader) for r in deduplicate.assign_groups(df, config, first, growth).collect()}
        for q in ("q1", "q2"):
            want = greedy([r[1:] for r in rows if r[0] == q], config)
            assert {k[1:]: v for k, v in got.items() if k[0] == q} == want


def test_rounds_do_not_grow_with_the_groups(spark, monkeypatch):
    """10,000 groups of one query, two copies of each, and a chain in which each listing matches only its neighbours."""
    rounds, own = [], deduplicate._followers
    monkeypatch.setattr(deduplicate, "_followers", lambda todo, config: rounds.append(1) or own(todo, config))
    rows = [("q", f"{i:05d}", "p", 0, [f"a{i % 10_000}", f"b{i % 10_000}", f"c{i % 10_000}", *(["extra"] if i >= 10_000 else [])]) for i in range(20_000)]
    rows += [("q", f"z{i}", "p", 0, [f"n{i}", f"n{i + 1}", f"n{i + 2}", f"n{i + 3}"]) for i in range(9)]
    df = spark.createDataFrame(rows, "query string, listing_id string, provider string, ordinal long, tokens array<string>")
    config = DeduplicationConfig(match_config=MatchConfig(same_threshold=0.6))
    got = {r.listing_id: r.leader.listing_id for r in deduplicate.assign_groups(df, config).collect()}
    assert len(rounds) <= 10 and got == {k[0]: v[0] for k, v in greedy([r[1:] for r in rows[:300] + rows[10_000:10_300] + rows[20_000:]], config).items()} | {f"{i:05d}": f"{i % 10_000:05d}" for i in range(20_000)}


def test_least_share_loses_no_match():
    rng = random.Random(4)
    for c in (MatchConfig(), MatchConfig(overlap_weight=0.0), MatchConfig(overlap_weight=1.0, same_threshold=0.5), MatchConfig(shared_model_boost=0.9), MatchConfig(brand_conflict_factor=1.0, possible_threshold=0.0)):
        for possible in (False, True):
            config = DeduplicationConfig(include_possible_matches=possible, match_config=c)
            share, need = deduplicate.least_share(config), c.possible_threshold if possible else c.same_threshold
            for _ in range(2000):
                a, b = (set(rng.choices(["nvidia", "amd", "4090", "s24", "x", "y", "z", "ti"], k=rng.randrange(1, 8))) for _ in "ab")
                if plain_score(sorted(a), sorted(b), c) >= need:
                    assert len(a & b) >= share * min(len(a), len(b)) - 1e-9


def test_a_threshold_of_zero_makes_one_group(spark):
    df = spark.createDataFrame([("q", "b", "p", 0, ["x"]), ("q", "a", "p", 1, ["y"]), ("q", "c", "p", 2, [""]), ("r", "d", "p", 3, ["x"])], "query string, listing_id string, provider string, ordinal long, tokens array<string>")
    config = DeduplicationConfig(include_possible_matches=True, match_config=MatchConfig(possible_threshold=0.0))
    assert {r.listing_id: r.leader.listing_id for r in deduplicate.assign_groups(df, config).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def normal(spark, rows):
    df = spark.createDataFrame(rows, "query string, listing_id string, provider string, ordinal long, title string, price double, currency string, condition string, location string")
    return normalize.normalize(df)


def test_canonical_and_totals(spark):
    df = normal(spark, [("q", "b", "p2", 0, "rtx 4090 card", 10.0, "EUR", "new", None), ("q", "a", "p1", 1, "rtx 4090", 12.0, "EUR", "new", None), ("q", "c", "p3", 2, "chair", 1.0, "EUR", "new", None)])
    grouped = deduplicate.assign_groups(df)
    groups = {r.c.listing_id: r for r in deduplicate.canonical(grouped).collect()}
    assert set(groups) == {"b", "c"} and groups["b"].providers == ["p1", "p2"] and groups["b"].is_duplicate
    favoured = deduplicate.canonical(grouped, DeduplicationConfig(provider_priority=("p1",))).collect()
    assert {r.c.listing_id for r in favoured} == {"a", "c"}
    t = deduplicate.totals(deduplicate.canonical(grouped)).first()
    assert (t.total_groups, t.total_input, t.duplicates_removed) == (2, 3, 1)
    alone = deduplicate.assign_groups(df, DeduplicationConfig(enabled=False))
    assert deduplicate.canonical(alone).count() == 3


def prices(spark, values, config=None, weights=None, currencies=None):
    rows = [("g", float(v), (currencies or ["EUR"] * len(values))[i], float((weights or [1] * len(values))[i])) for i, v in enumerate(values)]
    return pricing.market_prices(spark.createDataFrame(rows, "g string, price double, currency string, weight double"), ["g"], config).first()


def test_price_strategies(spark):
    assert prices(spark, [10, 20, 30]).estimated_market_price == 20
    assert prices(spark, [1, 2, 3, 4, 100], PricingConfig(strategy="trimmed_mean", trim_fraction=0.2, remove_outliers=False)).estimated_market_price == 3
    assert prices(spark, [10, 20], PricingConfig(strategy="weighted_average"), [1, 3]).estimated_market_price == 17.5
    assert prices(spark, [10, 20], PricingConfig(strategy="weighted_average"), [0, 0]).estimated_market_price == 15
    assert prices(spark, [10, 20, 60], PricingConfig(strategy=lambda p, w: F.max(p))).estimated_market_price == 60
    with pytest.raises(ValueError):
        PricingConfig(strategy="odd")


def test_outliers_currency_confidence(spark):
    r = prices(spark, [95, 100, 100, 105, 110, 100000])
    assert r.outliers_removed == 1 and r.estimated_market_price == 100 and r.max_price == 110 and r.reliable
    r = prices(spark, [100, 110, 90], currencies=["EUR", "EUR", "USD"])
    assert (r.currency, r.comparable_count, r.max_price, r.reliable) == ("EUR", 2, 110, False)
    assert prices(spark, [100, 110], currencies=["EUR", "USD"]).currency == "EUR"
    assert prices(spark, [100, 110, 90], PricingConfig(currency="USD"), currencies=["EUR", "EUR", "USD"]).mean_price == 90
    r = prices(spark, [100, 110])
    assert r.confidence_score == pytest.approx(0.4 / (1 + 10 / 105), abs=1e-4)


def test_group_without_price(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    p = pricing.market_prices(spark.createDataFrame([("a", 5.0, "EUR", 1.0)], "g string, price double, currency string, weight double"), ["g"])
    got = {r.g: r.market for r in pricing.attach_prices(groups, p, ["g"]).collect()}
    assert got["a"].estimated_market_price == 5 and got["b"].estimated_market_price is None and got["b"].comparable_count == 0 and got["b"].strategy == "median"


@pytest.mark.parametrize("config", [PricingConfig(), PricingConfig(strategy="trimmed_mean", trim_fraction=0.15), PricingConfig(strategy="weighted_average", remove_outliers=False), PricingConfig(currency="USD"), PricingConfig(strategy=lambda p, w: F.max(p))], ids=["median", "trimmed", "weighted", "currency", "own"])
def test_large_groups_have_the_figures_of_small_ones(spark, monkeypatch, config):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(7)
    rows = [(g, float(round(rng.lognormvariate(4, 1), 2)), rng.choice(["EUR", "EUR", "USD"]), rng.choice([1.0, 0.5, 2.0])) for g, n in (("a", 900), ("b", 701), ("c", 5), ("d", 3), ("e", 1), (None, 300)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("f", 5.0, None, 1.0), ("c", None, "EUR", 1.0)], "g string, price double, currency string, weight double")
    try:
        key = lambda r: (r.g is None, r.g)
        want = sorted(pricing.market_prices(df, ["g"], config).collect(), key=key)
        assert None in {r.g for r in want}
        for large, listed in ((0, 10_000), (400, 0)):
            monkeypatch.setattr(pricing, "_LISTED", listed)
            assert sorted(pricing.market_prices(df, ["g"], config, large=large).collect(), key=key) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_range_has_a_whole_large_group(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit("g").alias("g"), (100 + F.col("id") / 1000).alias("price"), F.lit("EUR").alias("currency"), F.lit(1.0).alias("weight"))
        sizes = [r["count"] for r in pricing.in_ranges(pricing.by_price(df, ["g"]), ["g"]).groupBy("_range").count().collect()]
        assert sum(sizes) == 1_000_000 and max(sizes) < 150_000
        got = pricing.market_prices(df, ["g"], PricingConfig(strategy="trimmed_mean", trim_fraction=0.25)).first()
        assert (got.median_price, got.mean_price, got.estimated_market_price, got.comparable_count, got.outliers_removed) == (600.0, 600.0, 600.0, 1_000_000, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def huber_step(reach):
    """One step of a Huber mean from 100: deviations beyond the reach count as much as at it."""
    add = lambda s, p, n: (s[0] + float((np.clip(p - 100, -reach, reach) * n).sum()), s[1] + int(n.sum()))
    return PairStrategy("huber", lambda: (0.0, 0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: 100 + s[0] / s[1] if s[1] else None)


def test_strategies_in_python_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(pair_strategies, "PART", 50)
    rng = random.Random(4)
    rows = [(g, float(round(rng.lognormvariate(4.5, 0.6), 1)), "EUR", 1.0) for g, n in (("a", 600), ("b", 3), (None, 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, price double, currency string, weight double")
    for large in (10, 10_000):
        config = PricingConfig(strategy=huber_step(20), remove_outliers=False)
        got = {r.g: r for r in pricing.market_prices(df, ["g"], config, large=large).collect()}
        for g in ("a", "b", None):
            own = [r[1] for r in rows if r[0] == g]
            want = 100 + sum(max(-20, min(20, p - 100)) for p in own) / len(own)
            assert got[g].estimated_market_price == pytest.approx(want, abs=0.0051) and got[g].strategy == "huber" and got[g].comparable_count == len(own)
    none = PairStrategy("none", list, lambda s, p, n: s, lambda a, b: a, lambda s: None)
    assert {r.estimated_market_price for r in pricing.market_prices(df, ["g"], PricingConfig(strategy=none)).collect()} == {None}


FREE = OpportunityConfig(marketplace_fee_rate=0, payment_fee_rate=0, payment_fee_flat=0, shipping_cost=0, packaging_cost=0, buffer_rate=0)


def offer(spark, ask, sale, config=None, confidence=1.0, currency="EUR", market_currency="EUR"):
    df = spark.createDataFrame([(ask, currency, (sale, confidence, market_currency))], "price double, currency string, market struct<estimated_market_price double, confidence_score double, currency string>")
    return opportunity.analyze(df, config).first()


def test_costs_and_tiers(spark):
    r = offer(spark, 500.0, 1000.0)
    assert r.costs.total == 191.35 and r.recommendation == "strong_buy" and r.net_profit == 308.65
    for sale, want in ((200.0, "strong_buy"), (120.0, "buy"), (110.0, "watch"), (103.0, "reject"), (100.0, "reject")):
        assert offer(spark, 100.0, sale, FREE).recommendation == want
    assert offer(spark, 100.0, 200.0, FREE, 0.5).recommendation == "buy"
    low = offer(spark, 100.0, 200.0, FREE, 0.3)
    assert low.recommendation == "watch" and "confidence 0.30 < 0.40 -> capped at WATCH" in low.reasons
    assert offer(spark, 0.0, 10.0, FREE).roi_percentage == 0


def test_guards(spark):
    assert offer(spark, None, 10.0).reasons == ["listing has no asking price"]
    assert offer(spark, 10.0, None).reasons == ["no market price estimate available"]
    r = offer(spark, 10.0, 20.0, currency="€")
    assert r.recommendation == "reject" and r.asking_price is None and r.reasons == ["currency mismatch: asking € vs market EUR"]
    assert offer(spark, 10.0, 20.0, OpportunityConfig(require_same_currency=False), currency="€").asking_price == 10


def test_scores(spark):
    df = spark.createDataFrame([(30.0, 200.0, 1.0, 0.0), (None, None, 0.0, 1.0), (15.0, 100.0, 0.5, 0.5)], "r double, p double, c double, k double")
    out = df.select(opportunity.score_signals(F.coalesce(F.col("r") / 30, F.lit(0.0)), F.coalesce(F.col("p") / 200, F.lit(0.0)), F.col("c"), F.col("k")).alias("s")).collect()
    assert [r.s.score for r in out] == [100.0, 0.0, 50.0]
    m = spark.createDataFrame([((100.0, 100.0, 99.0, 101.0, 5),), ((None, None, None, None, 0),)], "m struct<estimated_market_price double, median_price double, min_price double, max_price double, comparable_count long>")
    risks = [r.r for r in m.select(opportunity.risk(F.col("m"), ScoringConfig()).alias("r")).collect()]
    assert risks[0] < 0.05 and risks[1] == 1.0


def test_rank_and_filters(spark):
    rows = [("q", "a", "reject", None, 0.1, None, 5.0), ("q", "b", "strong_buy", 50.0, 0.9, 10.0, 90.0), ("q", "c", "buy", 20.0, 0.5, 9.0, 60.0), ("q", "d", "strong_buy", 50.0, 0.8, 8.0, 80.0), ("q", "e", "watch", 6.0, 0.7, 1.0, 40.0)]
    df = spark.createDataFrame(rows, "query string, listing_id string, recommendation string, roi_percentage double, confidence_score double, net_profit double, recommendation_score double")
    for order in list(permutations(range(5)))[::37]:
        shuffled = spark.createDataFrame([rows[i] for i in order], df.schema)
        assert [r.listing_id for r in ranking.with_rank(shuffled).orderBy("rank").collect()] == ["b", "d", "c", "e", "a"]
    ids = lambda x: sorted(r.listing_id for r in x.collect())
    assert ids(ranking.select_items(df, actionable_only=True)) == ["b", "c", "d"]
    assert ids(ranking.select_items(df, min_recommendation="watch")) == ["b", "c", "d", "e"]
    assert ids(ranking.select_items(df, min_roi=20.0)) == ["b", "c", "d"] and ids(ranking.select_items(df, min_net_profit=9.0)) == ["b", "c"]
    assert [r.listing_id for r in df.orderBy(*ranking.order("net_profit")).collect()] == ["b", "c", "d", "e", "a"]
    assert {r.recommendation: r.n for r in ranking.counts_by_recommendation(df.where("false")).collect()} == {"strong_buy": 0, "buy": 0, "watch": 0, "reject": 0}


def stored(spark, rows):
    full = [(rank, title, "Ebay", score, roi, 100.0, 0.6, risk) for rank, title, score, roi, risk in rows]
    return spark.createDataFrame(full, "rank long, title string, provider string, recommendation_score double, roi_percentage double, net_profit double, confidence_score double, risk_score double")


def test_compare(spark):
    old = stored(spark, [(1, "Same", 50.0, 20.0, 0.3), (2, "Up", 50.0, 20.0, 0.3), (3, "Gone", 50.0, 20.0, 0.3), (4, "Risk", 50.0, 20.0, 0.3), (5, "Tie", 50.0, None, 0.3), (9, "same ", 1.0, 1.0, 0.3)])
    new = stored(spark, [(1, " same", 50.0, 20.0, 0.3), (2, "UP", 60.0, 1.0, 0.3), (3, "Fresh", 50.0, 20.0, 0.3), (4, "Risk", 50.0, 20.0, 0.2), (5, "Tie", 50.0, 0.0, 0.3)])
    got = {r.key: r for r in compare.compare(old, new).collect()}
    assert {k: r.category for k, r in got.items()} == {"ebay|same": "unchanged", "ebay|up": "improved", "ebay|gone": "disappeared", "ebay|fresh": "new", "ebay|risk": "improved", "ebay|tie": "unchanged"}
    assert got["ebay|up"].reason == "recommendation_score 50.00 -> 60.00 (+10.00)" and got["ebay|fresh"].roi_percentage_delta == 20
    assert [r.category for r in compare.in_display_order(compare.compare(old, new)).collect()] == ["new", "improved", "improved", "unchanged", "unchanged", "disappeared"]
    assert {r.category: r.n for r in compare.counts_by_category(compare.compare(old, old)).collect()}["unchanged"] == 5
    loose = compare.compare(old, new, ComparisonConfig(epsilon=100.0))
    assert compare.by_category(loose, "improved").count() == 0


def test_match_config_is_used(spark):
    df = spark.createDataFrame([("q", "a", "p", 0, ["x", "y"]), ("q", "b", "p", 1, ["x", "z"])], "query string, listing_id string, provider string, ordinal long, tokens array<string>")
    loose = DeduplicationConfig(match_config=MatchConfig(same_threshold=0.3, possible_threshold=0.2))
    assert deduplicate.assign_groups(df, loose).select("leader").distinct().count() == 1
    assert deduplicate.assign_groups(df).select("leader").distinct().count() == 2
