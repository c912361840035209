"""Queries over what the main ones do not show: pages of JSON, saved runs, texts of reasons, orders and totals; with DuckDB SQL.

Every docstring names the operators that a query applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as q
from .config import ACCESSORY_TERMS, BRANDS, EXCLUDED_TERMS, PART_TERMS, DeduplicationConfig, PricingConfig
from .functions import similarity, terms, text
from .functions.rounding import fixed
from .operators import compare, deduplicate, pricing, ranking
from .operators.pair_strategies import modal_price
from .plans.history import History
from .plans.pipeline import Result
from .shared import cut, numbered
from .sources import marketplace_json, spark_sources, typed_json
from .sources.scan import default_sources, scan


def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's order over all sources, and what each source adds in ``extra``."""
    n = q._table(spark, sf_dir, "nation").count()
    found = scan(spark, f"  {q.QUERY}", default_sources(), n)
    return found.select("ordinal", "query", "provider", "listing_id", F.element_at("extra", "rank").alias("rank"), F.element_at("extra", "mock").alias("mock"))


def _scan_order_sql() -> str:
    one = "SELECT {k} * 1000000000::BIGINT + i AS ordinal, '  {q}' AS query, '{s}' AS provider, '{s}-' || substr(sha256('{s}|{q}|' || i), 1, 8) AS listing_id, i::VARCHAR AS rank, 'true' AS mock FROM range((SELECT count(*) FROM nation)) t(i)"
    return " UNION ALL ".join(one.format(k=k, q=q.QUERY, s=s.name) for k, s in enumerate(default_sources()))


def registered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, S3: the synthetic sources as a registered Spark format, in three partitions each, as many rows as there are parts, with the nation of each place."""
    spark_sources.register(spark)
    n = q._table(spark, sf_dir, "part").count()
    found = spark.read.format("stallmark_synthetic").options(query=q.QUERY, limit=str(n), parts="3").load()
    some = found.where(F.col("ordinal").between(1_000_000_005, 2_000_000_000 + n // 2))
    keyed = some.withColumn("n_nationkey", (F.col("rank").cast("int") % 25).cast("int"))
    return keyed.join(q._table(spark, sf_dir, "nation"), "n_nationkey").select("ordinal", "provider", "listing_id", "title", "url", "price", "currency", "location", "condition", "n_name")


def _registered_sql() -> str:
    parts = []
    for k, s in enumerate(default_sources()):
        places = ", ".join(f"'{x}'" for x in s.locations)
        parts.append(
            f"SELECT {k} * 1000000000::BIGINT + i AS ordinal, i, '{s.name}' AS provider, '{s.name}-' || h AS listing_id, '{q.QUERY.title()} - {s.name} listing #' || (i + 1) AS title, '{s.base_url}/item/' || h AS url, round(50.0::DOUBLE + (seed % 195000) / 100.0::DOUBLE, 2) AS price, "
            f"'{s.currency}' AS currency, ([{places}])[(seed % {len(s.locations)})::INT + 1] AS location, (['new', 'used', 'refurbished'])[(seed % 3)::INT + 1] AS condition "
            f"FROM (SELECT i, substr(sha256('{s.name}|{q.QUERY}|' || i), 1, 8) AS h, ('0x' || substr(sha256('{s.name}|{q.QUERY}|' || i), 1, 8))::BIGINT AS seed FROM range((SELECT count(*) FROM part)) t(i))"
        )
    return f"SELECT ordinal, provider, listing_id, title, url, price, currency, location, condition, n_name FROM ({' UNION ALL '.join(parts)}) x JOIN nation ON n_nationkey = i % 25 WHERE ordinal BETWEEN 1000000005 AND 2000000000 + (SELECT count(*) FROM part) // 2"


def _pick(values: list[str | None], by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


def _picked(values: list[str | None], by: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[({by}) % {len(values)} + 1]"


_CODES: list[str | None] = ["1000", "1500", "1750", "2000", "2010", "2500", "3000", "7000", None, "9999"]
_WORDS: list[str | None] = ["New", "Certified - Refurbished", "For parts or not working", "Acceptable", "Odd", None, "brand new other"]
_MONEY: list[str | None] = ["", "USD", "GBP", None]


def search_page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON pages of fifty, read back as listings."""
    key, size = F.col("p_partkey"), F.col("p_size")
    amount = lambda x, money: F.struct(fixed(x).alias("value"), money.alias("currency"))
    some = lambda every, x: F.when(key % every != 0, x)
    item = F.struct(
        F.concat(F.lit("v1|"), key.cast("string"), F.lit("|0")).alias("itemId"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.concat(F.lit("https://example.com/itm/"), key.cast("string")).alias("itemWebUrl"),
        some(11, amount(F.col("p_retailprice"), _pick(_MONEY, key))).alias("price"),
        _pick(_CODES, key).alias("conditionId"),
        _pick(_WORDS, size).alias("condition"),
        F.struct(some(4, F.lit("Cork")).alias("city"), some(3, F.lit("Munster")).alias("stateOrProvince"), F.col("p_brand").alias("postalCode"), some(5, F.lit("IE")).alias("country")).alias("itemLocation"),
        F.struct(F.col("p_brand").alias("username"), (size * 1.0).alias("feedbackScore")).alias("seller"),
        F.array(F.lit("FIXED_PRICE"), F.lit(""), F.lit("BEST_OFFER")).alias("buyingOptions"),
        F.array(F.struct(size.cast("string").alias("categoryId"), F.col("p_type").alias("categoryName"))).alias("categories"),
        F.array(F.struct(amount(size / F.lit(4.0), F.lit("EUR")).alias("shippingCost"), (size > 25).alias("guaranteedDelivery"))).alias("shippingOptions"),
        (key % 2 == 0).alias("adultOnly"),
        (size + 0.5).alias("watchCount"),
        F.struct(amount(F.col("p_retailprice") * 2, F.lit("EUR")).alias("originalPrice")).alias("marketingPrice"),
        F.array(F.struct(F.lit("https://i/1").alias("imageUrl")), F.struct(F.lit("").alias("imageUrl")), F.struct(F.lit("https://i/2").alias("imageUrl"))).alias("additionalImages"),
    )
    parts = q._table(spark, sf_dir, "part")
    pages = parts.groupBy((key / 50).cast("long").alias("page")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(item).alias("itemSummaries"))).alias("text")).select("text")
    pages = pages.union(spark.createDataFrame([('{"total": 0, "limit": 50, "offset": 0}',)], "text string"))
    found = marketplace_json.search_listings(pages)
    extra = lambda *names: [F.element_at("extra", n).alias(n) for n in names]
    return found.select(
        "listing_id", "title", "provider", "url", "price", "currency", "location", "condition", F.size("extra").cast("long").alias("n_extra"),
        *extra("seller", "seller_feedback_score", "buying_options", "category_id", "category_name", "shipping_cost", "shipping_guaranteed_delivery", "adult_only", "watch_count", "original_price", "additional_image_urls", "item_city", "condition_text"),
    )


_CODE_SQL = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in marketplace_json.CONDITION_CODES.items()) + " END"
_SEARCH_SQL = f"""
WITH p AS (SELECT *, p_partkey AS k, {_picked(_CODES, 'p_partkey')} AS code, {_picked(_WORDS, 'p_size')} AS words, CASE WHEN p_partkey % 11 <> 0 THEN {_picked(_MONEY, 'p_partkey')} END AS money,
  CASE WHEN p_partkey % 4 <> 0 THEN 'Cork' END AS city, CASE WHEN p_partkey % 3 <> 0 THEN 'Munster' END AS state, CASE WHEN p_partkey % 5 <> 0 THEN 'IE' END AS country FROM part)
SELECT 'v1|' || k || '|0' AS listing_id, p_name || ' ' || p_type AS title, 'ebay_browse' AS provider, 'https://example.com/itm/' || k AS url,
  CASE WHEN k % 11 <> 0 THEN printf('%.2f', p_retailprice)::DOUBLE END AS price, coalesce(nullif(money, ''), 'EUR') AS currency, concat_ws(', ', coalesce(city, state, p_brand), country) AS location,
  coalesce({_CODE_SQL}, CASE WHEN contains(lower(words), 'refurb') THEN 'refurbished' WHEN contains(lower(words), 'new') THEN 'new' WHEN regexp_matches(lower(words), 'used|parts|good|acceptable') THEN 'used' END, 'unknown') AS condition,
  (14 + (code IS NOT NULL)::INT + (words IS NOT NULL)::INT + (city IS NOT NULL)::INT + (state IS NOT NULL)::INT + (country IS NOT NULL)::INT)::BIGINT AS n_extra,
  p_brand AS seller, p_size::VARCHAR AS seller_feedback_score, 'FIXED_PRICE,BEST_OFFER' AS buying_options, p_size::VARCHAR AS category_id, p_type AS category_name, printf('%.2f', p_size / 4.0::DOUBLE) AS shipping_cost,
  (p_size > 25)::VARCHAR AS shipping_guaranteed_delivery, (k % 2 = 0)::VARCHAR AS adult_only, (p_size + 0.5::DOUBLE)::VARCHAR AS watch_count, printf('%.2f', p_retailprice * 2) AS original_price, 'https://i/1,https://i/2' AS additional_image_urls,
  city AS item_city, words AS condition_text FROM p
"""


#: What stands in a field of a faulty page, by part: another kind of value, and the message it gives.
_FAULTS = [
    ('"title":12345', "itemSummaries[].title: expected text, got number"), ('"itemWebUrl":true', "itemSummaries[].itemWebUrl: expected text, got boolean"), ('"price":{"value":9.5}', "itemSummaries[].price.value: expected text, got number"),
    ('"price":"9.50"', "itemSummaries[].price: expected object, got text"), ('"watchCount":false', "itemSummaries[].watchCount: expected number, got boolean"), ('"seller":["u"]', "itemSummaries[].seller: expected object, got list"),
    ('"price":{"currency":"EUR"}', "itemSummaries[].price.value: missing field"), ('"categories":[{"categoryId":5}]', "itemSummaries[].categories[0].categoryId: expected text, got number"), ('"subtitle":null,"buyingOptions":[5]', None),
]


def refused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON pages of one item, most of them with a value of another type; which are refused, and for what."""
    key = F.col("p_partkey")
    item = F.concat(F.lit('{"itemId":"'), key.cast("string"), F.when(key % 7 != 0, '","title":"t').otherwise(""), F.lit('","itemWebUrl":"u",'), _pick([f for f, _ in _FAULTS], key), F.lit("}"))
    # A field given twice is no JSON for Spark, so that the faulty one stands alone.
    once = F.regexp_replace(F.regexp_replace(item, r'"title":"t",(.*"title":)', "$1"), r'"itemWebUrl":"u",(.*"itemWebUrl":)', "$1")
    text = F.when(key % 50 == 0, '{"itemSummaries": [').when(key % 50 == 1, '{"itemSummaries": {}}').otherwise(F.concat(F.lit('{"itemSummaries": ['), once, F.lit("]}")))
    pages = q._table(spark, sf_dir, "part").select(key.alias("part_id"), text.alias("text"))
    return typed_json.refused(pages, "itemSummaries", marketplace_json.SEARCH_ITEM).select("part_id", F.coalesce("place", F.lit(-1)).alias("place"), F.array_join("problems", "; ").alias("problems"))


_REFUSED_SQL = f"""
WITH p AS (SELECT p_partkey AS k, {_picked([m for _, m in _FAULTS], 'p_partkey')} AS m, p_partkey % {len(_FAULTS)} AS f FROM part),
told AS (SELECT k AS part_id, CASE WHEN k % 50 > 1 THEN 0 ELSE -1 END::INT AS place, CASE WHEN k % 50 = 0 THEN 'page: not JSON' WHEN k % 50 = 1 THEN 'itemSummaries: expected list, got object'
  ELSE nullif(concat_ws('; ', CASE WHEN k % 7 = 0 AND f <> 0 THEN 'itemSummaries[].title: missing field' END, m), '') END AS problems FROM p)
SELECT part_id, place, problems FROM told WHERE problems IS NOT NULL
"""


def catalog_page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog pages, line items as the market data of most of them."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("p-"), key.cast("string"))
    product = F.struct(
        name.alias("productId"), F.when(key % 5 != 0, F.concat(F.lit("part-"), key.cast("string"))).alias("urlKey"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("productType"),
        F.struct(F.when(F.col("p_size") > 20, "red").alias("colorway"), F.col("p_retailprice").alias("retailPrice"), F.lit("").alias("season")).alias("productAttributes"),
    )
    parts = q._table(spark, sf_dir, "part")
    pages = parts.groupBy((key / 40).cast("long").alias("page")).agg(F.to_json(F.struct(F.count("*").alias("count"), F.collect_list(product).alias("products"))).alias("text")).select("text")
    each = F.col("l_extendedprice") / F.col("l_quantity")
    variant = F.struct(F.col("l_linenumber").cast("string").alias("variantId"), F.lit("USD").alias("currencyCode"), F.when(F.col("l_linenumber") < 7, fixed(each)).alias("lowestAskAmount"), fixed(each * 0.75).alias("highestBidAmount"))
    lines = q._table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 13 != 0)
    market = lines.groupBy(F.concat(F.lit("p-"), F.col("l_partkey").cast("string")).alias("product_id")).agg(F.to_json(F.collect_list(variant)).alias("text"))
    found = marketplace_json.catalog_listings(pages, market)
    extra = lambda *names: [F.element_at("extra", n).alias(n) for n in names]
    return found.select("listing_id", "title", "provider", "url", "price", "currency", "condition", F.size("extra").cast("long").alias("n_extra"), *extra("brand", "colorway", "retail_price", "variant_count", "lowest_ask", "highest_bid"))


_PLAIN = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"
_CATALOG_SQL = f"""
WITH m AS (SELECT l_partkey AS k, min(CASE WHEN l_linenumber < 7 THEN printf('%.2f', l_extendedprice / l_quantity)::DOUBLE END) AS ask, max(printf('%.2f', l_extendedprice / l_quantity * 0.75::DOUBLE)::DOUBLE) AS bid, count(*) AS n FROM lineitem WHERE l_partkey % 13 <> 0 GROUP BY 1)
SELECT 'p-' || p_partkey AS listing_id, p_name AS title, 'stockx' AS provider, 'https://stockx.com/' || CASE WHEN p_partkey % 5 <> 0 THEN 'part-' ELSE 'p-' END || p_partkey AS url, ask AS price, 'USD' AS currency, 'new' AS condition,
  (3 + (p_size > 20)::INT + (n IS NOT NULL)::INT + (ask IS NOT NULL)::INT + (bid IS NOT NULL)::INT)::BIGINT AS n_extra, p_brand AS brand, CASE WHEN p_size > 20 THEN 'red' END AS colorway,
  {_PLAIN.format('p_retailprice')} AS retail_price, n::VARCHAR AS variant_count, {_PLAIN.format('ask')} AS lowest_ask, {_PLAIN.format('bid')} AS highest_bid
FROM part LEFT JOIN m ON k = p_partkey
"""


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are saved and read back, each opportunity with its run."""
    history = History(spark)
    empty = {"currency": F.lit("EUR"), "asking_price": F.lit(None).cast("double"), "estimated_market_price": F.col("net_profit"), "recommendation": F.lit("watch")}
    for late in (False, True):
        items = cut(q._run(spark, sf_dir, late).withColumns(empty))
        history.save(Result(f"late={late}", items, items), config_summary="query", created_at="2024-01-01T00:00:00+00:00")
    newest = F.lit(history.list_runs(1).first().run_id).cast("long").alias("newest_id")
    items = history.list_opportunities(1).unionByName(history.list_opportunities(2))
    return history.list_runs().join(items, "run_id").select("run_id", newest, "query", "created_at", "config_summary", "total_listings_scanned", "total_groups", "total_opportunities", "rank", "title", "provider", "currency", "asking_price", "estimated_market_price", "roi_percentage", "net_profit", "recommendation_score", "recommendation")


_SAVED_SQL = f"""
WITH {q._RUNS_SQL}
SELECT 1 + late::BIGINT AS run_id, 2::BIGINT AS newest_id, CASE WHEN late THEN 'late=True' ELSE 'late=False' END AS query, '2024-01-01T00:00:00+00:00' AS created_at, 'query' AS config_summary, count(*) OVER w AS total_listings_scanned, count(*) OVER w AS total_groups, count(*) OVER w AS total_opportunities,
  n AS rank, '  ' || brand || '   Deal ' AS title, provider, 'EUR' AS currency, NULL::DOUBLE AS asking_price, hi AS estimated_market_price, lo AS roi_percentage, hi AS net_profit, floor(least(100.0, n / 2.0) * 100 + 0.5) / 100 AS recommendation_score, 'watch' AS recommendation
FROM totals WINDOW w AS (PARTITION BY late)
"""


def changes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with their reasons, numbered in the order in which they are shown; unchanged ones left out."""
    deltas = compare.compare(q._run(spark, sf_dir, False), q._run(spark, sf_dir, True))
    parts = [compare.by_category(deltas, c) for c in ("new", "disappeared", "improved", "worsened")]
    shown = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return numbered(shown.withColumn("all", F.lit(1)), "all", compare.display_order(), "place").select("place", "category", "key", "reason")


_CHANGES_SQL = f"""
WITH {q._RUNS_SQL}
SELECT row_number() OVER (ORDER BY CASE category WHEN 'new' THEN 0 WHEN 'improved' THEN 1 WHEN 'worsened' THEN 2 ELSE 4 END, key) AS place, category, key, CASE WHEN fresh THEN 'new opportunity' WHEN gone THEN 'no longer present'
  WHEN abs(ds) > 1e-9 THEN printf('recommendation_score %.2f -> %.2f (%+.2f)', s0, s1, ds) WHEN abs(dr) > 1e-9 THEN printf('roi_percentage %.2f -> %.2f (%+.2f)', r0, r1, dr) ELSE printf('net_profit %.2f -> %.2f (%+.2f)', p0, p1, dp) END AS reason
FROM classed WHERE category <> 'unchanged'
"""


def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of each part's decision as texts."""
    return q._offers(spark, sf_dir).select("part_id", F.array_join("reasons", " | ").alias("reasons"))


_REASONS_SQL = f"""
WITH {q._OFFERS_SQL}
SELECT part_id, CASE WHEN guard IS NOT NULL THEN guard ELSE concat_ws(' | ', printf('net profit %.2f (%.1f%% ROI, %.1f%% margin); costs %.2f', net_profit, roi_percentage, margin_percentage, total_cost),
  CASE WHEN net_profit <= 0 THEN 'net profit <= floor 0.00 -> REJECT' WHEN t1 IS NULL THEN printf('ROI %.1f%% below watch threshold -> REJECT', roi_percentage) END,
  CASE WHEN net_profit > 0 AND t1 <> t2 THEN printf('confidence %.2f < 0.60 -> capped at BUY', confidence_score) END,
  CASE WHEN net_profit > 0 AND recommendation <> t2 THEN printf('confidence %.2f < 0.40 -> capped at WATCH', confidence_score) END,
  CASE WHEN net_profit > 0 AND t1 IS NOT NULL THEN printf('ROI %.1f%% -> ', roi_percentage) || recommendation END) END AS reasons FROM decided
"""


def sorted_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each part's offer by score, ROI, net profit and confidence."""
    out = q._offers(spark, sf_dir).select("listing_id", *ranking.SORTS.values()).withColumn("all", F.lit(1))
    for name in ranking.SORTS:
        out = numbered(out, "all", ranking.order(name), f"by_{name}")
    return out.select("listing_id", *(f"by_{name}" for name in ranking.SORTS))


_SORTED_SQL = f"WITH {q._OFFERS_SQL} SELECT listing_id, " + ", ".join(f"row_number() OVER (ORDER BY {c} DESC NULLS LAST, listing_id) AS by_{n}" for n, c in ranking.SORTS.items()) + " FROM scored"


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size, each with the next by id, under names of known brands; with the reasons as texts."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    title = F.concat_ws(" ", F.when(F.col("p_partkey") % 6 != 0, _pick(list(BRANDS), number)), "p_name", "p_type", F.concat(F.lit("x"), (F.col("p_partkey") % 5).cast("string"), F.lit("00")))
    parts = q._table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").alias("a"), text.tokenize(title).alias("ta"))
    w = Window.partitionBy("p_size").orderBy("a")
    pairs = parts.withColumn("b", F.lead("a").over(w)).withColumn("tb", F.lead("ta").over(w)).where("b is not null")
    config = DeduplicationConfig().match_config
    pairs = pairs.withColumns({"fa": similarity.features(F.col("ta"), config), "fb": similarity.features(F.col("tb"), config)})
    pairs = pairs.withColumn("score", similarity.pair_score(F.col("fa"), F.col("fb"), config))
    reasons = similarity.explain(F.col("fa"), F.col("fb"), F.col("score"), config)
    return pairs.select("a", "b", "score", F.array_join(reasons, " | ").alias("reasons"))


_EACH = "'[''' || array_to_string(list_sort({0}), ''', ''') || ''']'"
_BRAND_SQL = rf"""
WITH t AS (SELECT p_size, p_partkey AS a, list_distinct({q._TOKENS.format("concat_ws(' ', CASE WHEN p_partkey % 6 <> 0 THEN " + _picked(list(BRANDS), "regexp_extract(p_brand, '[0-9]+')::INT") + " END, p_name, p_type, 'x' || (p_partkey % 5) || '00')")}) AS ta FROM part),
l AS (SELECT a, ta, lead(a) OVER w AS b, lead(ta) OVER w AS tb FROM t WINDOW w AS (PARTITION BY p_size ORDER BY a)),
x AS (SELECT a, b, len(list_intersect(ta, tb)) AS inter, len(ta) AS na, len(tb) AS nb, len(list_distinct(list_concat(ta, tb))) AS uni,
  list_filter(ta, lambda y: regexp_matches(y, '[0-9]')) AS ma, list_filter(tb, lambda y: regexp_matches(y, '[0-9]')) AS mb, list_filter(ta, lambda y: list_contains({list(BRANDS)}, y)) AS ba, list_filter(tb, lambda y: list_contains({list(BRANDS)}, y)) AS bb FROM l WHERE b IS NOT NULL),
s AS (SELECT *, inter::DOUBLE / uni AS j, inter::DOUBLE / least(na, nb) AS o, {q._SIM} AS base FROM x),
m AS (SELECT *, CASE WHEN list_has_any(ma, mb) THEN base + (1 - base) * 0.4 ELSE least(base, 0.3) END AS s1, CASE WHEN len(ba) > 0 AND len(bb) > 0 THEN list_has_any(ba, bb) END AS brand FROM s),
d AS (SELECT *, floor(greatest(0.0, least(1.0, CASE WHEN brand THEN s1 + (1 - s1) * 0.15 WHEN NOT brand THEN s1 * 0.45 ELSE s1 END)) * 10000 + 0.5) / 10000 AS score FROM m)
SELECT a, b, score, concat_ws(' | ', printf('token similarity %.2f (jaccard=%.2f, overlap=%.2f; %d shared)', base, j, o, inter),
  CASE WHEN list_has_any(ma, mb) THEN 'shared model identifier(s): ' || array_to_string(list_sort(list_intersect(ma, mb)), ', ') ELSE 'conflicting model identifiers: ' || {_EACH.format('ma')} || ' vs ' || {_EACH.format('mb')} END,
  CASE WHEN brand THEN 'shared brand: ' || array_to_string(list_sort(list_intersect(ba, bb)), ', ') WHEN NOT brand THEN 'conflicting brands: ' || {_EACH.format('ba')} || ' vs ' || {_EACH.format('bb')} END,
  printf('decision %s at score %.2f', CASE WHEN score >= 0.72 THEN 'same_product' WHEN score >= 0.45 THEN 'possible_match' ELSE 'different_product' END, score)) AS reasons FROM d
"""

_TERMS = ["", *ACCESSORY_TERMS, *PART_TERMS, *EXCLUDED_TERMS]


def default_term_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes under the default term lists, of titles with each term in turn and a second one now and then."""
    key = F.col("p_partkey")
    title = F.concat_ws(" ", "p_brand", _pick(_TERMS, key), F.when(key % 3 == 0, _pick(_TERMS, key * 7)), F.col("p_name"))
    parts = q._table(spark, sf_dir, "part").select(key.alias("part_id"), title.alias("title"))
    return parts.select("part_id", terms.classify_title(F.col("title"), "brand 1").alias("v")).select("part_id", "v.*")


def _terms_sql() -> str:
    found = lambda words: f"list_filter({list(words)}, lambda x: contains(p, ' ' || x || ' '))"
    listed = lambda kind, name: f"'{kind} keyword' || CASE WHEN len({name}) > 1 THEN 's' ELSE '' END || ': ' || array_to_string({name}, ', ')"
    title = f"p_brand || ' ' || {_picked(_TERMS, 'p_partkey')} || ' ' || CASE WHEN p_partkey % 3 = 0 THEN {_picked(_TERMS, 'p_partkey * 7')} ELSE '' END || ' ' || p_name"
    return rf"""WITH t AS (SELECT p_partkey AS part_id, {q._TOKENS.format(title)} AS w FROM part), s AS (SELECT part_id, ' ' || array_to_string(w, ' ') || ' ' AS p, array_to_string(w, '') AS c FROM t),
        m AS (SELECT *, {found(EXCLUDED_TERMS)}[1] AS ex, list_filter(['brand', '1'], lambda x: NOT contains(c, x)) AS miss, {found(ACCESSORY_TERMS)} AS acc, {found(PART_TERMS)} AS prt FROM s)
        SELECT part_id,
          CASE WHEN ex IS NOT NULL THEN 'rejected' WHEN len(miss) = 2 THEN 'rejected' WHEN len(miss) > 0 THEN 'unknown' WHEN len(acc) > 0 THEN 'accessory' WHEN len(prt) > 0 THEN 'part' ELSE 'complete_product' END AS classification,
          CASE WHEN ex IS NOT NULL THEN 95 WHEN len(miss) = 2 THEN 90 WHEN len(miss) > 0 THEN 45 WHEN len(acc) = 1 THEN 90 WHEN len(acc) > 1 THEN 92 WHEN len(prt) > 0 THEN 90 WHEN contains(c, 'brand1') THEN 95 ELSE 80 END::INT AS match_confidence,
          CASE WHEN ex IS NOT NULL THEN 'Excluded keyword: ' || ex WHEN len(miss) = 2 THEN 'Missing required term: brand 1' WHEN len(miss) > 0 THEN 'Partial match; missing required term: ' || array_to_string(miss, ' ')
            WHEN len(acc) > 0 THEN {listed('Accessory', 'acc')} WHEN len(prt) > 0 THEN {listed('Part', 'prt')} WHEN contains(c, 'brand1') THEN 'Strong model match' ELSE 'All required terms present' END AS reason FROM m"""


def custom_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the market price of each part by a strategy given as a function, here the largest one, but 1,000 at most."""
    capped = PricingConfig(strategy=lambda price, weight: F.least(F.max(price), F.lit(1000.0)))
    return pricing.market_prices(q._priced(spark, sf_dir), q.KEYS, capped).select("part_id", "currency", "estimated_market_price", "comparable_count")


def modal_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the most usual price band of each part, by a strategy in Python whose states are merged."""
    return pricing.market_prices(q._priced(spark, sf_dir), q.KEYS, PricingConfig(strategy=modal_price(50))).select("part_id", "currency", "estimated_market_price", "comparable_count", "strategy")


def condition_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed means of each raw condition, whose groups hold a quarter or more of all rows: ranked by many tasks."""
    priced = q.listings(spark, sf_dir).where("price is not null").withColumn("currency", text.currency_code(F.col("currency")))
    priced = priced.select("condition", "price", "currency", F.col("weight").cast("double").alias("weight"))
    return pricing.market_prices(priced, ["condition"], PricingConfig(strategy="trimmed_mean"), large=500).drop("strategy")


def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, listings and removed duplicates of each brand's parts."""
    return deduplicate.totals(deduplicate.canonical(deduplicate.assign_groups(q.parts_to_group(spark, sf_dir))))


_GROUPS_SQL = rf"""
RECURSIVE t AS (SELECT p_brand AS query, lpad(p_partkey::VARCHAR, 12, '0') AS id, list_sort(list_distinct({q._TOKENS.format("p_name || ' ' || p_type")})) AS ta, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(p_partkey::VARCHAR, 12, '0')) AS i FROM part),
x AS (SELECT a.query, a.i, b.i AS j, len(list_intersect(a.ta, b.ta)) AS inter, len(a.ta) AS na, len(b.ta) AS nb, len(list_distinct(list_concat(a.ta, b.ta))) AS uni FROM t a JOIN t b ON a.query = b.query AND b.i < a.i),
ok AS (SELECT query, i, list(j ORDER BY j) AS m FROM x WHERE floor(greatest(0.0, least(1.0, {q._SIM})) * 10000 + 0.5) / 10000 >= 0.72 GROUP BY query, i),
cand AS (SELECT t.query, t.i, coalesce(m, []) AS m FROM t LEFT JOIN ok ON ok.query = t.query AND ok.i = t.i),
walk AS (SELECT DISTINCT query, 0::BIGINT AS i, []::BIGINT[] AS leaders, 0::BIGINT AS leader FROM t
  UNION ALL SELECT query, i + 1, CASE WHEN h IS NULL THEN list_append(leaders, i + 1) ELSE leaders END, coalesce(h, i + 1)
  FROM (SELECT w.query, w.i, w.leaders, list_filter(c.m, lambda y: list_contains(w.leaders, y))[1] AS h FROM walk w JOIN cand c ON c.query = w.query AND c.i = w.i + 1)),
placed AS (SELECT t.query, t.id, t.ta, l.id AS leader FROM walk w JOIN t ON t.query = w.query AND t.i = w.i JOIN t l ON l.query = w.query AND l.i = w.leader),
grouped AS (SELECT query, leader, arg_min({{'id': id, 'ta': ta}}, (-len(ta), id)) AS c, count(*) AS group_size FROM placed GROUP BY query, leader)"""

SQL = {
    "scan_order": _scan_order_sql(),
    "search_page_listings": _SEARCH_SQL,
    "catalog_page_listings": _CATALOG_SQL,
    "refused_pages": _REFUSED_SQL,
    "registered_sources": _registered_sql(),
    "saved_runs": _SAVED_SQL,
    "changes_in_order": _CHANGES_SQL,
    "reason_texts": _REASONS_SQL,
    "sorted_opportunities": _SORTED_SQL,
    "brand_pairs": _BRAND_SQL,
    "default_term_classes": _terms_sql(),
    "modal_prices": f"WITH {q._FENCED_SQL}, bands AS (SELECT part_id, floor(price / 50) AS b, count(*) AS m FROM kept GROUP BY ALL), modes AS (SELECT part_id, arg_min(b, (-m, b)) AS b FROM bands GROUP BY part_id) SELECT part_id, currency, (b + 0.5) * 50 AS estimated_market_price, comparable_count, 'modal_price' AS strategy FROM prices JOIN modes USING (part_id)",
    "condition_price_stats": f"WITH {q._FENCED_SQL.replace('l_partkey AS part_id', 'condition AS part_id')} SELECT {q._PRICE_COLUMNS.format(e='trimmed_price').replace('part_id', 'part_id AS condition', 1)} FROM prices",
    "custom_strategy": f"WITH {q._FENCED_SQL} SELECT part_id, currency, least(max_price, 1000.0) AS estimated_market_price, comparable_count FROM prices",
    "dedup_groups": f"WITH {_GROUPS_SQL} SELECT query, leader, c.id AS canonical, group_size, substr(sha256('tokens=' || array_to_string(c.ta, ' ') || '|currency=EUR|condition=new'), 1, 16) AS fingerprint FROM grouped",
    "dedup_totals": f"WITH {_GROUPS_SQL} SELECT query, count(*) AS total_groups, sum(group_size)::BIGINT AS total_input, (sum(group_size) - count(*))::BIGINT AS duplicates_removed FROM grouped GROUP BY query",
}
QUERIES = {f.__name__: f for f in (scan_order, search_page_listings, catalog_page_listings, refused_pages, registered_sources, saved_runs, changes_in_order, reason_texts, sorted_opportunities, brand_pairs, default_term_classes, custom_strategy, modal_prices, condition_price_stats, dedup_totals)}
