"""Queries over the star-schema tables, and the same in DuckDB's SQL.

Line items are the listings: part and supplier give title and source, the
supplier's region the currency, the return flag the condition. Every docstring
names the operators that a query applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ClassificationConfig, DeduplicationConfig, OpportunityConfig, PricingConfig, ScoringConfig
from .functions import similarity, terms, text
from .functions.rounding import money
from .operators import compare, deduplicate, normalize, opportunity, pricing, ranking
from .sources.scan import default_sources, scan

KEYS = ["part_id"]
QUERY = "cable 12"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings, with their part, order date and quantity."""
    lines, parts, suppliers, nations = (_table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation"))
    region = F.col("n_regionkey")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" p"), F.col("p_partkey").cast("string")).alias("title"),
            F.col("s_name").alias("provider"),
            F.when(F.col("l_linenumber") < 7, money(F.col("l_extendedprice") / F.col("l_quantity"))).alias("price"),
            F.when(region == 0, "€").when(region == 1, "USD").when(region == 2, "eur").when(region == 3, "pounds").otherwise("xyz").alias("currency"),
            F.when(F.col("l_returnflag") == "A", "pre-owned").when(F.col("l_returnflag") == "N", "Brand  New").otherwise("refurb").alias("condition"),
            F.concat(F.lit("  co. "), F.lower("n_name")).alias("location"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_shipdate").alias("shipped"),
            F.col("l_quantity").alias("weight"),
            F.col("p_brand").alias("brand"),
        )
    )


_LISTINGS_SQL = """
listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
    p_brand || ' ' || p_name || ' p' || p_partkey AS title, s_name AS provider,
    CASE WHEN l_linenumber < 7 THEN floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS price,
    CASE n_regionkey WHEN 0 THEN '€' WHEN 1 THEN 'USD' WHEN 2 THEN 'eur' WHEN 3 THEN 'pounds' ELSE 'xyz' END AS currency,
    CASE n_regionkey WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'XYZ' END AS n_currency,
    CASE l_returnflag WHEN 'A' THEN 'pre-owned' WHEN 'N' THEN 'Brand  New' ELSE 'refurb' END AS condition,
    CASE l_returnflag WHEN 'A' THEN 'used' WHEN 'N' THEN 'new' ELSE 'refurbished' END AS n_condition,
    '  co. ' || lower(n_name) AS location, l_partkey AS part_id, l_shipdate AS shipped, l_quantity AS weight, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparables with normalized currencies."""
    found = listings(spark, sf_dir)
    return found.where("price is not null").withColumn("currency", text.currency_code(F.col("currency"))).select("part_id", "price", "currency", F.col("weight").cast("double").alias("weight"))


_FENCED_SQL = (
    _LISTINGS_SQL
    + """,
priced AS (SELECT part_id, price, n_currency AS currency, weight FROM listings WHERE price IS NOT NULL),
counted AS (SELECT part_id, currency, count(*) AS c FROM priced GROUP BY ALL),
chosen AS (SELECT part_id, arg_min(currency, (-c, currency)) AS currency FROM counted GROUP BY part_id),
picked AS (SELECT p.* FROM priced p JOIN chosen USING (part_id, currency)),
ordered AS (SELECT part_id, count(*) AS n, list_sort(list(price)) AS s FROM picked GROUP BY part_id),
quarts AS (SELECT part_id, n,
    CASE WHEN floor((n - 1) * 0.25) = ceil((n - 1) * 0.25) THEN s[floor((n - 1) * 0.25)::INT + 1] ELSE (ceil((n - 1) * 0.25) - (n - 1) * 0.25) * s[floor((n - 1) * 0.25)::INT + 1] + ((n - 1) * 0.25 - floor((n - 1) * 0.25)) * s[ceil((n - 1) * 0.25)::INT + 1] END AS q1,
    CASE WHEN floor((n - 1) * 0.75) = ceil((n - 1) * 0.75) THEN s[floor((n - 1) * 0.75)::INT + 1] ELSE (ceil((n - 1) * 0.75) - (n - 1) * 0.75) * s[floor((n - 1) * 0.75)::INT + 1] + ((n - 1) * 0.75 - floor((n - 1) * 0.75)) * s[ceil((n - 1) * 0.75)::INT + 1] END AS q3
  FROM ordered),
kept AS (SELECT p.*, n FROM picked p JOIN quarts USING (part_id) WHERE n < 4 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY price) AS place, count(*) OVER (PARTITION BY part_id) AS k FROM kept),
stats AS (SELECT part_id, any_value(currency) AS currency, min(price) AS lo, max(price) AS hi, list_sort(list(price)) AS s, count(*) AS cnt, any_value(n) AS n,
    sum(price::DECIMAL(28,6))::DOUBLE / count(*) AS mean,
    sum(CASE WHEN place BETWEEN floor(k * 0.1) + 1 AND k - floor(k * 0.1) THEN price::DECIMAL(28,6) END)::DOUBLE / count(CASE WHEN place BETWEEN floor(k * 0.1) + 1 AND k - floor(k * 0.1) THEN 1 END) AS trimmed,
    sum((price * weight)::DECIMAL(28,6))::DOUBLE / sum(weight::DECIMAL(28,6))::DOUBLE AS weighted
  FROM placed GROUP BY part_id),
prices AS (SELECT part_id, currency, floor(lo * 100 + 0.5) / 100 AS min_price, floor(hi * 100 + 0.5) / 100 AS max_price,
    floor((s[(cnt + 1) // 2] + s[cnt // 2 + 1]) / 2 * 100 + 0.5) / 100 AS median_price, floor(mean * 100 + 0.5) / 100 AS mean_price,
    floor(trimmed * 100 + 0.5) / 100 AS trimmed_price, floor(weighted * 100 + 0.5) / 100 AS weighted_price,
    cnt AS comparable_count, n - cnt AS outliers_removed,
    floor(least(1.0, cnt / 5.0) * CASE WHEN cnt > 1 AND mean > 0 THEN 1 / (1 + (hi - lo) / mean) ELSE 1.0 END * 10000 + 0.5) / 10000 AS confidence_score,
    cnt >= 3 AS reliable
  FROM stats)"""
)
_PRICE_COLUMNS = "part_id, currency, {e} AS estimated_market_price, min_price, max_price, median_price, mean_price, comparable_count, outliers_removed, confidence_score, reliable"


def _prices(spark: SparkSession, sf_dir: str, strategy: str = "median") -> DataFrame:
    return pricing.market_prices(_priced(spark, sf_dir), KEYS, PricingConfig(strategy=strategy)).drop("strategy")


def group_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median prices of each part."""
    return _prices(spark, sf_dir)


def group_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A5, W4."""
    return _prices(spark, sf_dir, "trimmed_mean")


def group_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    return _prices(spark, sf_dir, "weighted_average")


def group_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, F5."""
    return pricing.quartiles(pricing.select_currency(_priced(spark, sf_dir), KEYS), KEYS)


def dominant_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, T10."""
    return pricing.dominant_currency(_priced(spark, sf_dir), KEYS)


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest listing of each part, with the part's market price: N4, A9, A14."""
    found = listings(spark, sf_dir).withColumn("currency", text.currency_code(F.col("currency")))
    order = F.struct(F.coalesce("price", F.lit(float("inf"))), "listing_id")
    best = found.groupBy("part_id").agg(F.min_by(F.struct("listing_id", "title", "provider", "price", "currency"), order).alias("c"))
    flat = pricing.attach_prices(best, pricing.market_prices(_priced(spark, sf_dir), KEYS), KEYS).select("part_id", "c.*", "market")
    return opportunity.score(opportunity.analyze(flat, OpportunityConfig()), ScoringConfig())


_OFFERS_SQL = (
    _FENCED_SQL
    + """,
best AS (SELECT part_id, unnest(arg_min({'listing_id': listing_id, 'title': title, 'provider': provider, 'price': price, 'currency': n_currency}, (coalesce(price, 'inf'::DOUBLE), listing_id)), max_depth := 2) FROM listings GROUP BY part_id),
joined AS (SELECT b.part_id, b.listing_id, b.title, b.provider, b.currency, b.price, p.median_price AS sale, p.currency AS market_currency, p.min_price, p.max_price, coalesce(p.comparable_count, 0) AS comparable_count, coalesce(p.confidence_score, 0.0) AS confidence_score
  FROM best b LEFT JOIN prices p USING (part_id)),
guarded AS (SELECT *, CASE WHEN price IS NULL THEN 'listing has no asking price' WHEN sale IS NULL THEN 'no market price estimate available'
    WHEN market_currency IS NOT NULL AND currency <> market_currency THEN 'currency mismatch: asking ' || currency || ' vs market ' || market_currency END AS guard FROM joined),
cost AS (SELECT *, CASE WHEN guard IS NULL THEN price END AS asking_price, CASE WHEN guard IS NULL THEN sale END AS estimated_market_price,
    CASE WHEN guard IS NULL THEN floor((floor(sale * 0.1 * 100 + 0.5) / 100 + floor((sale * 0.029 + 0.35) * 100 + 0.5) / 100 + 10.0 + 2.0 + floor((sale * 0.05 + 0.0) * 100 + 0.5) / 100 + floor(greatest(0.0, sale - price) * 0.0 * 100 + 0.5) / 100) * 100 + 0.5) / 100 END AS total_cost FROM guarded),
profit AS (SELECT *, floor((estimated_market_price - asking_price) * 100 + 0.5) / 100 AS gross_profit, floor((estimated_market_price - asking_price - total_cost) * 100 + 0.5) / 100 AS net_profit FROM cost),
ratio AS (SELECT *, CASE WHEN asking_price <= 0 THEN 0.0 ELSE floor(net_profit / asking_price * 100 * 100 + 0.5) / 100 END AS roi_percentage,
    CASE WHEN estimated_market_price <= 0 THEN 0.0 ELSE floor(net_profit / estimated_market_price * 100 * 100 + 0.5) / 100 END AS margin_percentage FROM profit),
tiers AS (SELECT *, CASE WHEN roi_percentage / 100 >= 0.3 THEN 'strong_buy' WHEN roi_percentage / 100 >= 0.15 THEN 'buy' WHEN roi_percentage / 100 >= 0.05 THEN 'watch' END AS t1 FROM ratio),
capped AS (SELECT *, CASE WHEN t1 = 'strong_buy' AND confidence_score < 0.6 THEN 'buy' ELSE t1 END AS t2 FROM tiers),
decided AS (SELECT *, CASE WHEN guard IS NOT NULL OR net_profit <= 0 THEN 'reject' ELSE coalesce(CASE WHEN t2 IN ('strong_buy', 'buy') AND confidence_score < 0.4 THEN 'watch' ELSE t2 END, 'reject') END AS recommendation FROM capped),
signals AS (SELECT *, coalesce(greatest(0.0, least(1.0, roi_percentage / 30.0)), 0.0) AS r, coalesce(greatest(0.0, least(1.0, net_profit / 200.0)), 0.0) AS p, greatest(0.0, least(1.0, confidence_score)) AS c,
    CASE WHEN sale IS NULL OR sale = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (CASE WHEN sale > 0 THEN greatest(0.0, least(1.0, (max_price - min_price) / sale / 1.0)) ELSE 1.0 END + greatest(0.0, least(1.0, (5 - comparable_count) / 5.0))) / 2)) END AS k FROM decided),
scored AS (SELECT *, floor(greatest(0.0, least(1.0, (0.35 * r + 0.25 * p + 0.25 * c - 0.15 * k + 0.15) / (0.35 + 0.25 + 0.25 + 0.15))) * 100 * 100 + 0.5) / 100 AS recommendation_score, floor(k * 10000 + 0.5) / 10000 AS risk_score FROM signals),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE recommendation WHEN 'strong_buy' THEN 0 WHEN 'buy' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END, roi_percentage DESC NULLS LAST, confidence_score DESC, listing_id) AS rank FROM scored)"""
)


def opportunity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D3, D4, D5, J12, A17, N4."""
    out = _offers(spark, sf_dir)
    return out.select("part_id", "listing_id", "currency", "asking_price", "estimated_market_price", F.col("costs.total").alias("total_cost"), "gross_profit", "net_profit", "roi_percentage", "margin_percentage", "recommendation")


def recommendation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, D8, D9, D10."""
    out = _offers(spark, sf_dir)
    return out.select("part_id", *(F.col(f"signals.{x}").alias(x) for x in ("roi_signal", "profit_signal", "confidence_signal", "risk_signal")), "recommendation_score", "risk_score")


def ranked_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actionable parts with their rank among all of their brand's."""
    out = ranking.with_rank(_offers(spark, sf_dir).withColumn("query", F.split_part("title", F.lit(" "), F.lit(1))))
    chosen = ranking.select_items(out, actionable_only=True, min_recommendation="buy", min_roi=20.0, min_net_profit=5.0)
    return chosen.select("query", "rank", "listing_id", "recommendation", "roi_percentage", "net_profit")


def recommendation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return ranking.counts_by_recommendation(_offers(spark, sf_dir))


def opportunity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guards' reasons, and how many reasons each part has."""
    out = _offers(spark, sf_dir)
    return out.select("part_id", F.size("reasons").cast("long").alias("n_reasons"), F.when(F.col("asking_price").isNull(), F.col("reasons")[0]).alias("guard"))


_SPLIT = "1998-01-01"


def _run(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """One of two runs: supplier and brand totals of the lines shipped before, or since, a day."""
    found = listings(spark, sf_dir).where("price is not null")
    found = found.where(F.col("shipped") >= F.lit(_SPLIT).cast("timestamp")) if late else found.where(F.col("shipped") < F.lit(_SPLIT).cast("timestamp"))
    stats = found.groupBy("provider", "brand").agg(F.count("*").alias("n"), F.max("price").alias("hi"), F.min("price").alias("lo"))
    return stats.select(
        F.col("n").alias("rank"), F.concat(F.lit("  "), F.col("brand"), F.lit("   Deal ")).alias("title"), "provider",
        money(F.least(F.lit(100.0), F.col("n") / 2.0)).alias("recommendation_score"), F.col("lo").alias("roi_percentage"), F.col("hi").alias("net_profit"),
        F.lit(0.5).alias("confidence_score"), F.lit(0.25).alias("risk_score"),
    )


_RUNS_SQL = (
    _LISTINGS_SQL
    + f""",
totals AS (SELECT shipped >= TIMESTAMP '{_SPLIT}' AS late, provider, brand, count(*) AS n, max(price) AS hi, min(price) AS lo FROM listings WHERE price IS NOT NULL GROUP BY ALL),
keyed AS (SELECT late, lower(trim(provider)) || '|' || lower(brand || ' Deal') AS key, provider, '  ' || brand || '   Deal ' AS title, floor(least(100.0, n / 2.0) * 100 + 0.5) / 100 AS score, lo, hi FROM totals),
pairs AS (SELECT coalesce(o.key, w.key) AS key, coalesce(w.provider, o.provider) AS provider, coalesce(w.title, o.title) AS title, o.key IS NULL AS fresh, w.key IS NULL AS gone,
    o.score AS s0, w.score AS s1, o.lo AS r0, w.lo AS r1, o.hi AS p0, w.hi AS p1
  FROM (SELECT * FROM keyed WHERE NOT late) o FULL JOIN (SELECT * FROM keyed WHERE late) w ON o.key = w.key),
deltas AS (SELECT *, coalesce(s1, 0) - coalesce(s0, 0) AS ds, coalesce(r1, 0) - coalesce(r0, 0) AS dr, coalesce(p1, 0) - coalesce(p0, 0) AS dp FROM pairs),
classed AS (SELECT *, CASE WHEN fresh THEN 'new' WHEN gone THEN 'disappeared' WHEN abs(ds) > 1e-9 THEN CASE WHEN ds > 0 THEN 'improved' ELSE 'worsened' END
    WHEN abs(dr) > 1e-9 THEN CASE WHEN dr > 0 THEN 'improved' ELSE 'worsened' END WHEN abs(dp) > 1e-9 THEN CASE WHEN dp > 0 THEN 'improved' ELSE 'worsened' END ELSE 'unchanged' END AS category FROM deltas)"""
)


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, A15, T14, D12, D13, U2."""
    out = compare.compare(_run(spark, sf_dir, False), _run(spark, sf_dir, True))
    return out.select("category", "key", "provider", "title", *(f"{m}_{x}" for m in ("recommendation_score", "roi_percentage", "net_profit") for x in ("old", "new", "delta")))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return compare.counts_by_category(compare.compare(_run(spark, sf_dir, False), _run(spark, sf_dir, True)))


def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest orders, as runs; a top-k report."""
    orders = _table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderkey").alias("run_id")).agg(F.max("o_totalprice").alias("total")).orderBy(F.col("run_id").desc()).limit(100)


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the listings' titles."""
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit(" The NEW "), F.col("p_brand"), F.lit("   "), F.col("p_name"), F.lit(" p"), F.col("p_partkey").cast("string")).alias("title"), F.col("p_partkey").alias("part_id"))
    parts = parts.withColumns({"currency": F.lit("$"), "condition": F.lit("new"), "location": F.lit(None).cast("string")})
    out = normalize.normalize(parts)
    return out.select("part_id", F.col("n_title").alias("title"), F.array_join("tokens", " ").alias("tokens"))


def normalized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency, condition and place of each listing, counted."""
    # Each distinct triple is cleaned once.
    found = listings(spark, sf_dir).groupBy("currency", "condition", "location").agg(F.count("*").alias("n"))
    out = found.select(text.currency_code(F.col("currency")).alias("currency"), text.condition_name(F.col("condition")).alias("condition"), text.location_name(F.col("location")).alias("location"), "n")
    return out.groupBy("currency", "condition", "location").agg(F.sum("n").alias("n"))


def title_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the parts' names for the brand and type asked for."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("title"))
    config = ClassificationConfig(accessory_terms=("blue", "dark green", "small"), part_terms=("brass", "nickel", "plated steel"), excluded_terms=("red", "anodized tin"))
    verdict = terms.classify_title(F.col("title"), "brand 1", config)
    return parts.select("part_id", verdict.alias("v")).select("part_id", "v.*")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size, each with the next by id."""
    parts = _table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("a"), text.tokenize(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("ta"))
    w = Window.partitionBy("p_brand", "p_size").orderBy("a")
    pairs = parts.withColumn("b", F.lead("a").over(w)).withColumn("tb", F.lead("ta").over(w)).where("b is not null")
    config = DeduplicationConfig().match_config
    pairs = pairs.withColumn("fa", similarity.features(F.col("ta"), config)).withColumn("fb", similarity.features(F.col("tb"), config))
    pairs = pairs.withColumn("score", similarity.pair_score(F.col("fa"), F.col("fb"), config))
    return pairs.select("a", "b", "score", similarity.decision(F.col("score"), config).alias("decision"), F.size(F.array_intersect("fa.tokens", "fb.tokens")).cast("long").alias("n_matched"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15, X8."""
    found = listings(spark, sf_dir)
    out = found.select("listing_id", text.fingerprint(text.tokenize(F.col("title")), text.currency_code(F.col("currency")), text.condition_name(F.col("condition"))).alias("fingerprint"))
    return out.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("listing_id").alias("first_id"))


def parts_to_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as normalized listings, those of a brand under one query."""
    parts = _table(spark, sf_dir, "part")
    return parts.select(F.col("p_brand").alias("query"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("listing_id"), F.lit("parts").alias("provider"), F.lit(0).cast("long").alias("ordinal"), text.tokenize(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"), F.lit("EUR").alias("n_currency"), F.lit("new").alias("n_condition"))


def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand grouped by their names and types."""
    groups = deduplicate.canonical(deduplicate.assign_groups(parts_to_group(spark, sf_dir)))
    return groups.select("query", F.col("leader.listing_id").alias("leader"), F.col("c.listing_id").alias("canonical"), "group_size", "fingerprint")


def union_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic sources, as many rows of each as there are nations."""
    n = _table(spark, sf_dir, "nation").count()
    return scan(spark, QUERY, default_sources(), n).select("provider", "listing_id", "title", "url", "price", "currency", "location", "condition")


def _union_scan_sql() -> str:
    parts = []
    for s in default_sources():
        places = ", ".join(f"'{x}'" for x in s.locations)
        parts.append(
            f"SELECT '{s.name}' AS provider, '{s.name}-' || h AS listing_id, '{QUERY.title()} - {s.name} listing #' || (i + 1) AS title, '{s.base_url}/item/' || h AS url, "
            f"round(50.0::DOUBLE + (seed % 195000) / 100.0::DOUBLE, 2) AS price, 'EUR' AS currency, ([{places}])[(seed % {len(s.locations)})::INT + 1] AS location, (['new', 'used', 'refurbished'])[(seed % 3)::INT + 1] AS condition "
            f"FROM (SELECT i, substr(sha256('{s.name}|{QUERY}|' || i), 1, 8) AS h, ('0x' || substr(sha256('{s.name}|{QUERY}|' || i), 1, 8))::BIGINT AS seed FROM range((SELECT count(*) FROM nation)) t(i))"
        )
    return " UNION ALL ".join(parts)


def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 to T7 over whole documents, in the normal form NFC, which SQL has too: length and number of tokens of the cleaned text, and its hash."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.clean_text(text.remove_symbols(F.col("text")), "NFC").alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.size(text.tokenize(F.col("t"))).cast("long").alias("n_tokens"), F.sha2(F.col("t").cast("binary"), 256).alias("sha256"))


def _unicode_sql() -> str:
    single = {k: v for k, v in text.PUNCTUATION.items() if len(v) == 1}
    old, new = ("".join(x).replace("'", "''") for x in (single, single.values()))
    space = r"[\s\x{0B}\x{85}\p{Z}]+"
    return rf"""WITH s AS (SELECT doc_id, nfc_normalize(regexp_replace(text, '[\p{{So}}\p{{Sk}}]', '', 'g')) AS t FROM documents),
        c AS (SELECT doc_id, replace(translate(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{7F}}-\x{{9F}}\p{{Cf}}]', '', 'g'), '{old}', '{new}'), '…', '...') AS t FROM s),
        w AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{space}', ' ', 'g'), '^ | $', '', 'g') AS t FROM c)
        SELECT doc_id, length(t) AS n_chars, len(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+')) AS n_tokens, sha256(t) AS sha256 FROM w"""


_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9]+')"
_SIM = "(0.65 * (inter::DOUBLE / uni) + 0.35 * (inter::DOUBLE / least(na, nb)))"
SQL = {
    "group_price_stats": f"WITH {_FENCED_SQL} SELECT {_PRICE_COLUMNS.format(e='median_price')} FROM prices",
    "group_trimmed_mean": f"WITH {_FENCED_SQL} SELECT {_PRICE_COLUMNS.format(e='trimmed_price')} FROM prices",
    "group_weighted_mean": f"WITH {_FENCED_SQL} SELECT {_PRICE_COLUMNS.format(e='weighted_price')} FROM prices",
    "group_quartiles": f"WITH {_FENCED_SQL} SELECT part_id, n, q1, q3 FROM quarts",
    "dominant_currency": f"WITH {_FENCED_SQL} SELECT part_id, currency FROM chosen",
    "opportunity_decisions": f"WITH {_OFFERS_SQL} SELECT part_id, listing_id, currency, asking_price, estimated_market_price, total_cost, gross_profit, net_profit, roi_percentage, margin_percentage, recommendation FROM decided",
    "recommendation_scores": f"WITH {_OFFERS_SQL} SELECT part_id, floor(r * 10000 + 0.5) / 10000 AS roi_signal, floor(p * 10000 + 0.5) / 10000 AS profit_signal, floor(c * 10000 + 0.5) / 10000 AS confidence_signal, risk_score AS risk_signal, recommendation_score, risk_score FROM scored",
    "ranked_opportunities": f"WITH {_OFFERS_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY split_part(title, ' ', 1) ORDER BY rank) AS r2 FROM ranked) SELECT split_part(title, ' ', 1) AS query, r2 AS rank, listing_id, recommendation, roi_percentage, net_profit FROM own WHERE recommendation IN ('strong_buy', 'buy') AND roi_percentage >= 20 AND net_profit >= 5",
    "recommendation_counts": f"WITH {_OFFERS_SQL} SELECT v.recommendation, count(d.part_id) AS n FROM (VALUES ('strong_buy'), ('buy'), ('watch'), ('reject')) v(recommendation) LEFT JOIN decided d USING (recommendation) GROUP BY ALL",
    "opportunity_reasons": f"""WITH {_OFFERS_SQL} SELECT part_id, CASE WHEN guard IS NOT NULL THEN 1 WHEN net_profit <= 0 OR t1 IS NULL THEN 2 ELSE 2 + (t1 <> t2)::INT + (recommendation <> t2)::INT END::BIGINT AS n_reasons, guard FROM decided""",
    "run_diff": f"""WITH {_RUNS_SQL} SELECT category, key, provider, title, s0 AS recommendation_score_old, s1 AS recommendation_score_new, floor(ds * 1000000 + 0.5) / 1000000 AS recommendation_score_delta,
        r0 AS roi_percentage_old, r1 AS roi_percentage_new, floor(dr * 1000000 + 0.5) / 1000000 AS roi_percentage_delta, p0 AS net_profit_old, p1 AS net_profit_new, floor(dp * 1000000 + 0.5) / 1000000 AS net_profit_delta FROM classed""",
    "change_counts": f"WITH {_RUNS_SQL} SELECT v.category, count(c.key) AS n FROM (VALUES ('new'), ('disappeared'), ('unchanged'), ('improved'), ('worsened')) v(category) LEFT JOIN classed c USING (category) GROUP BY ALL",
    "top_runs": "SELECT o_orderkey AS run_id, max(o_totalprice) AS total FROM orders GROUP BY ALL ORDER BY run_id DESC LIMIT 100",
    "title_tokens": rf"""SELECT part_id, title, array_to_string(list_filter({_TOKENS.format('title')}, lambda t: t NOT IN ('the', 'a', 'an', 'for', 'with', 'and', 'brand', 'new', 'genuine', 'official')), ' ') AS tokens
        FROM (SELECT p_partkey AS part_id, lower(trim(regexp_replace(' The NEW ' || p_brand || '   ' || p_name || ' p' || p_partkey, '\s+', ' ', 'g'))) AS title FROM part)""",
    "normalized_fields": f"""WITH {_LISTINGS_SQL}, placed AS (SELECT n_currency AS currency, n_condition AS condition, 'Co. ' || array_to_string(list_transform(string_split(trim(regexp_replace(substr(trim(location), 5), '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS location FROM listings)
        SELECT currency, condition, location, count(*) AS n FROM placed GROUP BY ALL""",
    "title_classification": rf"""WITH t AS (SELECT p_partkey AS part_id, {_TOKENS.format("p_brand || ' ' || p_name || ' ' || p_type")} AS w FROM part), s AS (SELECT part_id, ' ' || array_to_string(w, ' ') || ' ' AS p, array_to_string(w, '') AS c FROM t),
        m AS (SELECT *, CASE WHEN contains(p, ' red ') THEN 'red' WHEN contains(p, ' anodized tin ') THEN 'anodized tin' END AS ex, list_filter(['brand', '1'], lambda x: NOT contains(c, x)) AS miss,
          list_filter(['blue', 'dark green', 'small'], lambda x: contains(p, ' ' || x || ' ')) AS acc, list_filter(['brass', 'nickel', 'plated steel'], lambda x: contains(p, ' ' || x || ' ')) AS prt FROM s)
        SELECT part_id,
          CASE WHEN ex IS NOT NULL THEN 'rejected' WHEN len(miss) = 2 THEN 'rejected' WHEN len(miss) > 0 THEN 'unknown' WHEN len(acc) > 0 THEN 'accessory' WHEN len(prt) > 0 THEN 'part' ELSE 'complete_product' END AS classification,
          CASE WHEN ex IS NOT NULL THEN 95 WHEN len(miss) = 2 THEN 90 WHEN len(miss) > 0 THEN 45 WHEN len(acc) = 1 THEN 90 WHEN len(acc) > 1 THEN 92 WHEN len(prt) > 0 THEN 90 WHEN contains(c, 'brand1') THEN 95 ELSE 80 END::INT AS match_confidence,
          CASE WHEN ex IS NOT NULL THEN 'Excluded keyword: ' || ex WHEN len(miss) = 2 THEN 'Missing required term: brand 1' WHEN len(miss) > 0 THEN 'Partial match; missing required term: ' || array_to_string(miss, ' ')
            WHEN len(acc) > 0 THEN 'Accessory keyword' || CASE WHEN len(acc) > 1 THEN 's' ELSE '' END || ': ' || array_to_string(acc, ', ') WHEN len(prt) > 0 THEN 'Part keyword' || CASE WHEN len(prt) > 1 THEN 's' ELSE '' END || ': ' || array_to_string(prt, ', ')
            WHEN contains(c, 'brand1') THEN 'Strong model match' ELSE 'All required terms present' END AS reason FROM m""",
    "pair_scores": rf"""WITH t AS (SELECT p_brand, p_size, p_partkey AS a, list_distinct({_TOKENS.format("p_brand || ' ' || p_name || ' ' || p_type")}) AS ta FROM part),
        l AS (SELECT a, ta, lead(a) OVER w AS b, lead(ta) OVER w AS tb FROM t WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY a)),
        x AS (SELECT a, b, len(list_intersect(ta, tb)) AS inter, len(ta) AS na, len(tb) AS nb, len(list_distinct(list_concat(ta, tb))) AS uni,
          list_filter(ta, lambda y: regexp_matches(y, '[0-9]') AND (regexp_matches(y, '[a-z]') OR length(y) >= 3)) AS ma, list_filter(tb, lambda y: regexp_matches(y, '[0-9]') AND (regexp_matches(y, '[a-z]') OR length(y) >= 3)) AS mb FROM l WHERE b IS NOT NULL),
        s AS (SELECT a, b, inter, floor(greatest(0.0, least(1.0, CASE WHEN len(ma) > 0 AND len(mb) > 0 THEN CASE WHEN list_has_any(ma, mb) THEN {_SIM} + (1 - {_SIM}) * 0.4 ELSE least({_SIM}, 0.3) END ELSE {_SIM} END)) * 10000 + 0.5) / 10000 AS score FROM x)
        SELECT a, b, score, CASE WHEN score >= 0.72 THEN 'same_product' WHEN score >= 0.45 THEN 'possible_match' ELSE 'different_product' END AS decision, inter AS n_matched FROM s""",
    "fingerprints": rf"""WITH {_LISTINGS_SQL}, f AS (SELECT listing_id, substr(sha256('tokens=' || array_to_string(list_sort(list_distinct({_TOKENS.format("title")})), ' ') || '|currency=' || n_currency || '|condition=' || n_condition), 1, 16) AS fingerprint FROM listings)
        SELECT fingerprint, count(*) AS n, min(listing_id) AS first_id FROM f GROUP BY ALL""",
    "union_scan": _union_scan_sql(),
    "unicode_clean": _unicode_sql(),
}
QUERIES = {f.__name__: f for f in (group_price_stats, group_trimmed_mean, group_weighted_mean, group_quartiles, dominant_currency, opportunity_decisions, recommendation_scores, ranked_opportunities, recommendation_counts, opportunity_reasons, run_diff, change_counts, top_runs, title_tokens, normalized_fields, title_classification, pair_scores, fingerprints, dedup_groups, union_scan, unicode_clean)}
