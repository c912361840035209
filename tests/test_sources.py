"""Sources, history, configuration, command line, streaming and registered queries."""

import csv
import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stallmark import cli, detail_queries, queries, render
from stallmark.config import ConfigError, PipelineConfig, ScannerConfig, load_pipeline_config, load_scanner_config
from stallmark.plans.history import History
from stallmark.plans.pipeline import Pipeline, analyze_listings
from stallmark.schemas import LISTING
from stallmark.sources import http, live, marketplace_json, requests, scan, spark_sources, typed_json
from stallmark.sources.synthetic import BUILT_IN
from stallmark.streaming.incremental import follow


def test_synthetic_rows_follow_from_their_hash(spark):
    rows = scan.search(spark, BUILT_IN[0], " rtx 4090 ", 5).collect()
    for i, r in enumerate(rows):
        digits = hashlib.sha256(f"ebay|rtx 4090|{i}".encode()).hexdigest()[:8]
        seed = int(digits, 16)
        assert r.listing_id == f"ebay-{digits}" and r.price == round(50 + seed % 195000 / 100, 2) and r.title == f"Rtx 4090 - ebay listing #{i + 1}"
        assert r.location == BUILT_IN[0].locations[seed % 4] and r.condition == ("new", "used", "refurbished")[seed % 3] and r.extra == {"mock": "true", "rank": str(i)}


class Broken:
    name = "broken"

    def fetch(self, spark, query, limit):
        raise http.Unreachable("down")


def test_scan(spark):
    out = scan.scan(spark, "x", [*BUILT_IN, Broken()], 3)
    assert out.count() == 12 and out.select("ordinal").distinct().count() == 12
    many = scan.scan(spark, "x", BUILT_IN[:2], 25).collect()
    assert sorted((r.ordinal, r.provider, r.extra["rank"]) for r in many) == [(k * 10**9 + i, s.name, str(i)) for k, s in enumerate(BUILT_IN[:2]) for i in range(25)]
    assert scan.scan(spark, "x", BUILT_IN, 0).count() == 0
    with pytest.raises(ValueError):
        scan.scan(spark, "  ", BUILT_IN)
    with pytest.raises(ValueError):
        scan.register_source(BUILT_IN[0])
    with pytest.raises(KeyError):
        scan.source_named("nothing")


ITEM = {
    "itemId": "v1|1", "title": "RTX 4090", "itemWebUrl": "https://x/1", "price": {"value": "1799.99", "currency": "EUR"}, "condition": "New", "conditionId": "1000",
    "itemLocation": {"city": "Dublin", "country": "IE"}, "buyingOptions": ["FIXED_PRICE", "BEST_OFFER"], "seller": {"username": "u", "feedbackPercentage": "99.5", "feedbackScore": 1234},
    "shippingOptions": [{"shippingCostType": "FIXED", "shippingCost": {"value": "5.00", "currency": "EUR"}, "guaranteedDelivery": True}], "categories": [{"categoryId": "27386", "categoryName": "GPU"}],
    "image": {"imageUrl": "https://i/1"}, "additionalImages": [{"imageUrl": "https://i/2"}, {"imageUrl": ""}, {"imageUrl": "https://i/3"}], "watchCount": 12, "adultOnly": False,
    "marketingPrice": {"originalPrice": {"value": "2000.00", "currency": "EUR"}, "discountPercentage": "10"}, "subtitle": "",
}


def page(items, **more):
    return json.dumps({"total": 4, "limit": 2, "offset": 0, "itemSummaries": items} | more)


def parse(spark, *texts):
    return marketplace_json.search_listings(spark.createDataFrame([(t,) for t in texts], "text string")).orderBy("listing_id").collect()


def test_search_pages(spark):
    bare = {"itemId": "v1|2", "title": "b", "itemWebUrl": "u", "itemLocation": {"country": "IE"}, "currentBidPrice": {"value": "999.00", "currency": "EUR"}, "bidCount": 14}
    used = {"itemId": "v1|3", "title": "c", "itemWebUrl": "u", "price": {"value": "10", "currency": ""}, "condition": "For parts", "itemLocation": {"city": "", "postalCode": "10001"}}
    first, second, third = parse(spark, page([ITEM, bare]), page([used]), json.dumps({"total": 0}))
    assert (first.price, first.currency, first.condition, first.location) == (1799.99, "EUR", "new", "Dublin, IE")
    x = first.extra
    assert x["buying_options"] == "FIXED_PRICE,BEST_OFFER" and x["seller_feedback_score"] == "1234" and x["shipping_cost"] == "5.00" and x["shipping_guaranteed_delivery"] == "true"
    assert x["additional_image_urls"] == "https://i/2,https://i/3" and x["watch_count"] == "12" and x["adult_only"] == "false" and x["original_price"] == "2000.00" and x["category_id"] == "27386"
    assert "subtitle" not in x and "epid" not in x
    assert (second.price, second.currency, second.condition, second.location) == (None, "EUR", "unknown", "IE") and second.extra["bid_count"] == "14"
    assert (third.price, third.currency, third.condition, third.location) == (10.0, "EUR", "used", "10001")
    for wrong in ({"itemId": "1"}, ITEM | {"price": {"value": "cheap", "currency": "EUR"}}, ITEM | {"price": {"value": "-1", "currency": "EUR"}}):
        with pytest.raises(Exception, match="missing field|not a price|expected"):
            parse(spark, page([wrong]))


def faulty(item, path, value):
    """The item with another value at a path."""
    out = json.loads(json.dumps(item))
    inner = out
    for name in path[:-1]:
        inner = inner[name]
    inner[path[-1]] = value
    return out


def kinds(shape, path=()):
    """(path, kind) of all checked fields of a shape."""
    for name in shape.required:
        yield (*path, name), "text"
    for name, kind in shape.optional.items():
        yield (*path, name), kind if isinstance(kind, str) else "object"
        if not isinstance(kind, str):
            yield from kinds(kind, (*path, name))
    for name, kind in shape.first.items():
        yield from kinds(kind, (*path, name, 0))


def sample(shape):
    out = {n: f"{n} x" for n in shape.required} | {n: {"text": "1", "number": 1.5, "boolean": True}[k] if isinstance(k, str) else sample(k) for n, k in shape.optional.items()}
    return out | {n: [sample(k)] for n, k in shape.first.items()} | {n: ["a", 5, None, "b"] for n in shape.texts} | {n: [{k: "u"}, {k: 5}, "odd", {}] for n, k in shape.each.items()}


@pytest.mark.parametrize(("shape", "listed"), [(marketplace_json.SEARCH_ITEM, "itemSummaries"), (marketplace_json.CATALOG_PRODUCT, "products")])
def test_every_field_is_checked_by_its_json_type(spark, shape, listed):
    good, rows, want = sample(shape), [], {}
    for path, kind in kinds(shape):
        for i, value in enumerate((7, True, "text", ["a"], {"a": 1}, None)):
            name = {0: "number", 1: "boolean", 2: "text", 3: "list", 4: "object", 5: "nothing"}[i]
            required = path[-1] in shape.required and len(path) == 1 or path[-2:] == ("price", "value")
            if name != kind and (name != "nothing" or required):
                key = f"{len(rows)}"
                rows.append((key, json.dumps({listed: [good, faulty(good, path, value)]})))
                want[key] = f"{listed}[]." + ".".join(str(x) for x in path).replace(".0", "[0]") + f": expected {kind}, got {name}"
    got = {r.key: (r.place, r.problems) for r in typed_json.refused(spark.createDataFrame([("good", json.dumps({listed: [good]})), *rows], "key string, text string"), listed, shape).collect()}
    assert len(rows) > 25 and got == {k: (1, [v]) for k, v in want.items()}


def test_malformed_pages_and_loose_lists(spark):
    texts = ["{", "[1]", '{"itemSummaries": "x"}', '{"itemSummaries": [5, null]}', '{"itemSummaries": null}', "{}", None, '{"itemSummaries": [{"itemId": "1"}]}']
    got = sorted((r.text or "", r.place is None, *r.problems) for r in typed_json.refused(spark.createDataFrame([(t,) for t in texts], "text string"), "itemSummaries", marketplace_json.SEARCH_ITEM).collect())
    assert got == sorted([
        ("{", True, "page: not JSON"), ("[1]", True, "page: expected object, got list"), ('{"itemSummaries": "x"}', True, "itemSummaries: expected list, got text"),
        ('{"itemSummaries": [5, null]}', False, "itemSummaries[]: expected object, got number"), ('{"itemSummaries": [5, null]}', False, "itemSummaries[]: expected object, got nothing"),
        ('{"itemSummaries": [{"itemId": "1"}]}', False, "itemSummaries[].title: missing field", "itemSummaries[].itemWebUrl: missing field"),
    ])
    loose = ITEM | {"buyingOptions": ["A", 5, None, ["x"], "B"], "leafCategoryIds": "no list", "thumbnailImages": [{"imageUrl": "u"}, {"imageUrl": 4}, 3], "shippingOptions": ["odd", {"type": 5}], "categories": {}}
    x = parse(spark, page([loose]))[0].extra
    assert x["buying_options"] == "A,B" and x["thumbnail_image_urls"] == "u" and "leaf_category_ids" not in x and "shipping_type" not in x and "category_id" not in x
    for wrong in ('{"itemSummaries": "x"}', "{", page([ITEM | {"title": 12345}]), page([ITEM | {"itemWebUrl": True}])):
        with pytest.raises(Exception, match="expected|not JSON"):
            marketplace_json.search_listings(spark.createDataFrame([(wrong,)], "text string")).select("price").collect()  # though the field is not read


PRODUCTS = {"count": 3, "pageNumber": 1, "pageSize": 2, "hasNextPage": False, "products": [{"productId": "p1", "urlKey": "shoe", "title": "Shoe", "brand": "B", "productAttributes": {"colorway": "red", "retailPrice": 120}}, {"productId": "p2", "title": "Boot"}]}
MARKET = [{"productId": "p1", "variantId": "a", "lowestAskAmount": "150", "highestBidAmount": "11"}, {"productId": "p1", "variantId": "b", "lowestAskAmount": "145", "highestBidAmount": None}, {"productId": "p1", "variantId": "c", "lowestAskAmount": "odd"}]


def test_catalog_pages(spark):
    pages = spark.createDataFrame([(json.dumps(PRODUCTS),)], "text string")
    market = spark.createDataFrame([("p1", json.dumps(MARKET)), ("p9", "[]")], "product_id string, text string")
    a, b = marketplace_json.catalog_listings(pages, market).orderBy("listing_id").collect()
    assert (a.price, a.currency, a.condition, a.url) == (145.0, "USD", "new", "https://stockx.com/shoe")
    assert a.extra == {"brand": "B", "colorway": "red", "retail_price": "120", "variant_count": "3", "lowest_ask": "145", "highest_bid": "11"}
    assert (b.price, b.url, b.extra) == (None, "https://stockx.com/p2", {})


class Wire:
    """A transport that replays answers by path and notes the requests."""

    def __init__(self, answers):
        self.answers, self.sent = answers, []

    def __call__(self, request):
        self.sent.append(request)
        found = next(v for k, v in self.answers.items() if k in request.full_url)
        found = found.pop(0) if isinstance(found, list) else found
        if isinstance(found, Exception):
            raise found
        return http.Response(200, (found if isinstance(found, str) else json.dumps(found)).encode())


TOKEN = {"token": {"access_token": "t", "expires_in": 7200, "token_type": "x"}}
SECRETS = {"EBAY_CLIENT_ID": "i", "EBAY_CLIENT_SECRET": "s", "STOCKX_API_KEY": "k", "STOCKX_CLIENT_ID": "i", "STOCKX_CLIENT_SECRET": "s"}


def test_live_search(spark):
    wire = Wire({"item_summary": [page([ITEM, ITEM | {"itemId": "v1|2"}], next="more"), http.BadStatus(503), page([ITEM | {"itemId": "v1|3"}], offset=2)]})
    tokens = Wire(TOKEN)
    waits = []
    source = live.live_source("ebay_browse", {"page_size": 2}, env=SECRETS, transport=wire, token_transport=tokens, sleep=waits.append, rng=lambda: 1.0)
    assert [r.listing_id for r in source.fetch(spark, "q" * 200, 10).collect()] == ["v1|1", "v1|2", "v1|3"]
    assert len(tokens.sent) == 1 and waits == [0.5] and len(wire.sent) == 3
    last = wire.sent[-1]
    assert last.params == {"q": "q" * 100, "limit": "2", "offset": "2"} and last.headers["Authorization"] == "Bearer t" and last.headers["X-EBAY-C-MARKETPLACE-ID"] == "EBAY_IE"
    assert scan.scan(spark, "x", [live.live_source("ebay_browse", {}, env=SECRETS, transport=Wire({"item": "no json"}), token_transport=tokens), BUILT_IN[0]], 2).count() == 2
    with pytest.raises(http.SourceConfigError):
        live.live_source("ebay_browse", {}, env={})
    with pytest.raises(http.SourceConfigError):
        live.live_source("ebay_browse", {"odd": 1}, env=SECRETS)


def test_live_catalog(spark, tmp_path):
    kept = http.TokenFile(tmp_path / "sub" / "t.json")
    with pytest.raises(http.SourceConfigError):
        live.live_source("stockx", {}, env=SECRETS, tokens=kept)
    kept.save({"refresh_token": "r"})
    wire = Wire({"catalog/search": PRODUCTS, "p1/market-data": [MARKET], "p2/market-data": http.BadStatus(404)})
    source = live.live_source("stockx", {}, env=SECRETS, transport=wire, token_transport=Wire({"token": {"access_token": "t", "expires_in": 1, "refresh_token": "r2"}}), tokens=kept)
    assert {r.listing_id: r.price for r in source.fetch(spark, "shoe", 5).collect()} == {"p1": 145.0, "p2": None}
    assert kept.load()["refresh_token"] == "r2" and (kept.path.stat().st_mode & 0o777) == 0o600


def test_retries_limits_tokens():
    policy = http.RetryPolicy(max_attempts=3, backoff_base=1.0)
    waits, answers = [], [http.BadStatus(429, retry_after=9.0), http.TimedOut("x"), http.Unreachable("y")]

    def send():
        raise answers[len(waits)]

    with pytest.raises(http.Unreachable) as e:
        policy.run(send, sleep=waits.append, rng=lambda: 0.0)
    assert waits == [9.0, 1.0] and e.value.attempts == 3
    with pytest.raises(http.BadStatus):
        policy.run(lambda: (_ for _ in ()).throw(http.BadStatus(404)), sleep=waits.append)
    assert policy.delay(10, lambda: 1.0) == 30.0
    now = [0.0]
    bucket = http.TokenBucket(2.0, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        bucket.acquire()
    assert now[0] == pytest.approx(1.0)
    clock = [0.0]
    wire = Wire(TOKEN)
    token = http.client_credentials("https://a/token", "i", "s", transport=wire, clock=lambda: clock[0])
    assert token() == token() == "Bearer t" and len(wire.sent) == 1
    clock[0] = 7150.0
    assert token() and len(wire.sent) == 2
    with pytest.raises(http.SourceAuthError):
        http.client_credentials("https://a/token", "i", "s", transport=Wire({"token": {}}))()
    assert http.Request("https://a/b", {"q": "a b"}).full_url == "https://a/b?q=a+b" and http.bearer("t")() == "Bearer t"


def test_real_transport():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 429)
            self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert http.send_with_urllib(http.Request(base + "/ok")).json() == {}
    with pytest.raises(http.BadStatus) as e:
        http.send_with_urllib(http.Request(base + "/no"))
    assert e.value.status == 429 and e.value.retry_after == 7
    server.shutdown()
    server.server_close()
    with pytest.raises(http.Unreachable):
        http.send_with_urllib(http.Request(base + "/ok", timeout=2))


TOML = """
[pipeline]
scan_limit = 4
[scanner]
providers = ["ebay", "donedeal"]
[matching]
same_threshold = 0.8
[market_pricing]
strategy = "trimmed_mean"
trim_fraction = 0.2
[opportunity]
shipping_cost = 3
[providers.ebay_browse]
enabled = false
page_size = 10
"""


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(TOML)
    c = load_pipeline_config(path)
    assert c.scan_limit == 4 and c.scanner.providers == ("ebay", "donedeal") and c.deduplication.match_config.same_threshold == 0.8
    assert c.pricing.strategy == "trimmed_mean" and c.opportunity.shipping_cost == 3.0 and c.live_providers["ebay_browse"]["page_size"] == 10
    for wrong in ("[odd]\n", "[scoring]\nodd = 1", "[deduplication]\nenabled = 1", "[market_pricing]\nmin_comparables = true", '[market_pricing]\nstrategy = "odd"', "[opportunity]\nbuy_roi = 0.9", "[providers.odd]\n", "[providers.stockx]\nodd = 1", "x = ", '[scanner]\nproviders = "ebay"'):
        path.write_text(wrong)
        with pytest.raises(ConfigError):
            load_pipeline_config(path)
    with pytest.raises(ConfigError):
        load_pipeline_config(tmp_path / "none.toml")
    path.write_text("[scanner]\nmax_results_per_provider = 3\nodd = 1")
    assert load_scanner_config(path).max_results_per_provider == 3 and load_scanner_config() == ScannerConfig()


def test_disabled_and_unknown_sources():
    c = PipelineConfig(scanner=ScannerConfig(providers=("ebay", "ebay_browse")), live_providers={"ebay_browse": {"enabled": False}})
    assert [s.name for s in scan.configured_sources(c)] == ["ebay"]
    with pytest.raises(KeyError):
        scan.configured_sources(PipelineConfig(scanner=ScannerConfig(providers=("odd",))))


def test_pipeline_and_history(spark, tmp_path):
    result = Pipeline(spark, PipelineConfig(scan_limit=5)).analyze("rtx 4090")
    items = result.items.orderBy("rank").collect()
    assert result.total_listings() == 20 and sum(r.group_size for r in items) == 20 and sum(result.counts().values()) == len(items)
    assert {r.classification.classification for r in result.listings.select("classification").collect()} == {"complete_product"}
    history = History(spark, str(tmp_path / "h"))
    assert history.list_runs().count() == 0 and history.get_run(1) is None
    assert history.save(result, created_at="2026-01-01T00:00:00+00:00") == 1 and history.save(result, config_summary="again") == 2
    assert [r.run_id for r in history.list_runs(1).collect()] == [2] and history.get_run(1).total_listings_scanned == 20
    saved = history.list_opportunities(1).collect()
    assert [(r.rank, r.title, r.recommendation_score) for r in saved] == [(r.rank, r.title, r.recommendation_score) for r in items]


def test_command_line(spark, tmp_path, capsys):
    db = str(tmp_path / "h")
    run = lambda *a: (cli.main([*a, "--db", db]), capsys.readouterr())
    code, out = run("scan", "rtx 4090", "-l", "3", "-p", "ebay", "-f", "json", "--save")
    data = json.loads(out.out)
    assert code == 0 and data["total_listings_scanned"] == 3 and data["shown"] == len(data["items"]) and "saved run 1" in out.err
    code, out = run("scan", "rtx 4090", "-l", "3", "-p", "ebay", "-f", "csv", "-s", "score", "--min-roi", "-1000", "--save")
    assert out.out.startswith("recommendation,recommendation_score,title,")
    assert run("scan", "x", "-l", "2", "--actionable-only", "--min-net-profit", "1e9", "-f", "markdown")[1].out.strip().endswith("_No opportunities._")
    assert "RUN  CREATED" in run("history")[1].out and json.loads(run("show", "1", "-f", "json")[1].out)["run"]["run_id"] == 1
    assert "unchanged" in run("compare", "1", "2")[1].out and json.loads(run("compare", "1", "2", "-f", "json")[1].out)["counts"]["new"] == 0
    assert run("compare", "1", "2", "-f", "markdown")[1].out.startswith("# Comparison") and run("compare", "1", "2", "-f", "csv")[1].out.startswith("category,key")
    code, out = run("show", "7")
    assert code == 1 and out.err == "error: run 7 not found\n"
    assert run("scan", " ")[0] == 1 and run("scan", "x", "-c", "/none.toml")[0] == 1


def test_whole_results_are_written_by_the_tasks(spark, tmp_path, capsys):
    def run(*a):
        assert cli.main([*a, "--db", str(tmp_path / "h")]) == 0
        return capsys.readouterr()

    def rows(folder, read):
        return [r for p in sorted((tmp_path / folder).glob("part-*")) for r in read(p.read_text().splitlines())]

    out = lambda name: ("--out", str(tmp_path / name))
    shown = run("scan", "rtx 4090", "-l", "4", "-f", "csv", "-s", "net_profit", "--save", *out("scan"), "--rows", "2")
    scanned = rows("scan", csv.DictReader)
    printed = list(csv.DictReader(shown.out.splitlines()))
    assert len(printed) == 2 and [r["title"] for r in printed] == [r["title"] for r in scanned[:2]] and len(scanned) > 2 and set(scanned[0]) == set(render.CSV_COLUMNS)
    assert [r["reasons"] for r in printed] == [r["reasons"] for r in scanned[:2]] and f"wrote {tmp_path / 'scan'}" in shown.err
    profits = [float(r["net_profit"]) for r in scanned if r["net_profit"]]
    assert profits == sorted(profits, reverse=True)
    shown = json.loads(run("show", "1", "-f", "json", *out("show"), "--rows", "1").out)
    saved = rows("show", lambda lines: map(json.loads, lines))
    assert len(shown["opportunities"]) == 1 and [r["rank"] for r in saved] == list(range(1, len(scanned) + 1))
    text = run("compare", "1", "1", *out("compare"), "--rows", "1").out
    assert f"unchanged={len(scanned)}" in text and [r["category"] for r in rows("compare", csv.DictReader)] == ["unchanged"] * len(scanned)
    assert cli.main(["show", "1", "--db", str(tmp_path / "h"), *out("show")]) == 1 and "error" in capsys.readouterr().err  # never overwritten


def test_rendering():
    assert render.cell(None) == "-" and render.cell(1.0) == "1.00" and render.cell(3) == "3"
    assert render.table(["A", "BB"], [["1", "2"]]).split("\n") == ["A  BB", "-  --", "1  2 "]
    assert (render.delta_cell(0.0), render.delta_cell(1.5), render.delta_cell(-2.0)) == ("=", "+1.50", "-2.00")
    assert render.runs("table", []) == "(no saved runs)"


def test_streaming(spark, tmp_path):
    listings = scan.scan(spark, "rtx 4090", BUILT_IN, 3)
    listings.write.parquet(str(tmp_path / "in"))
    history = History(spark, str(tmp_path / "h"))
    stream = spark.readStream.schema(listings.schema).parquet(str(tmp_path / "in"))
    follow(spark, stream, history, str(tmp_path / "c")).awaitTermination()
    run = history.list_runs().first()
    assert run.query == "rtx 4090" and run.total_listings_scanned == 12 and run.config_summary == f"stream={tmp_path / 'c'}, batch=0"
    follow(spark, stream, history, str(tmp_path / "c")).awaitTermination()
    assert history.list_runs().count() == 1 and history.list_opportunities(run.run_id).count() == run.total_opportunities > 0


def test_history_is_safe_for_several_writers(spark, tmp_path):
    result = Pipeline(spark, PipelineConfig(scan_limit=2)).analyze("rtx 4090")
    with History(spark, str(tmp_path / "h")) as first:
        second = History(spark, str(tmp_path / "h"))
        assert first._claim(2) == [1, 2] and second._claim(1) == [3]  # claimed, never finished
        assert first.save(result) == 4 and second.save_all(result.items, result.listings.withColumn("query", F.lit("x")), ["rtx 4090", "x"]) == {"rtx 4090": 5, "x": 6}
    assert [(r.run_id, r.total_listings_scanned) for r in first.list_runs().collect()] == [(6, 8), (5, 0), (4, 8)]
    (tmp_path / "h" / "version-9").mkdir()
    with pytest.raises(ValueError):
        History(spark, str(tmp_path / "h"))


KILLED_WHILE_SAVING = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from stallmark.config import PipelineConfig
from stallmark.plans.history import History
from stallmark.plans.pipeline import Pipeline
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
History._refuse_deleted = lambda self, ids: os._exit(9)  # items are written, the row of the run is not
History(spark, sys.argv[2]).save(Pipeline(spark, PipelineConfig(scan_limit=1)).analyze("rtx 4090"))
"""


def test_deleted_and_unfinished_runs_leave_nothing(spark, tmp_path):
    root, folder = Path(__file__).resolve().parents[1], tmp_path / "h"
    killed = subprocess.run([sys.executable, "-c", KILLED_WHILE_SAVING, str(root), str(folder), str(tmp_path / "c")], capture_output=True, timeout=600)
    assert killed.returncode == 9 and list((folder / "opportunities" / "run_id=1").glob("*.parquet"))
    history = History(spark, str(folder))
    assert history.get_run(1) is None and history.list_opportunities(1).count() == 0  # no reader sees half a run
    result = Pipeline(spark, PipelineConfig(scan_limit=1)).analyze("rtx 4090")
    assert history.save(result) == 2 and history.clean_up(older_than=3600) == []  # the first may still be at work
    (folder / "opportunities" / "_temporary").mkdir()
    assert history.clean_up(older_than=0) == [1] and history.clean_up(older_than=0) == []
    assert [p.name for p in (folder / "opportunities").iterdir() if p.is_dir()] == ["run_id=2"]
    assert history.list_opportunities(2).count() > 0 and history.delete_run(2) and not history.delete_run(2) and not history.delete_run(1)
    assert history.list_runs().count() == 0 and history.list_opportunities(2).count() == 0 and not (folder / "opportunities" / "run_id=2").exists()
    late = History(spark, str(folder))
    ids = late._claim(1)
    assert ids == [3] and history.clean_up(older_than=0) == [3]
    with pytest.raises(RuntimeError, match="deleted while"):
        late._refuse_deleted(ids)
    assert late.save(result) == 4 and late.get_run(4).total_listings_scanned == 4


def test_import_of_a_single_file_history(spark, tmp_path):
    import sqlite3

    file = str(tmp_path / "old.db")
    run = ["query", "created_at", "config_summary", "total_listings_scanned", "total_groups", "total_opportunities"]
    item = ["rank", "title", "provider", "currency", "asking_price", "estimated_market_price", "roi_percentage", "net_profit", "confidence_score", "risk_score", "recommendation_score", "recommendation"]
    with sqlite3.connect(file) as db:
        db.execute(f"CREATE TABLE runs (id INTEGER PRIMARY KEY, {', '.join(run)})")
        db.execute(f"CREATE TABLE opportunities (id INTEGER PRIMARY KEY, run_id INTEGER, {', '.join(item)})")
        db.execute("PRAGMA user_version = 1")
        db.execute("INSERT INTO runs VALUES (7, 'q', '2024-01-01T00:00:00+00:00', 'defaults', 3, 2, 2)")
        db.executemany("INSERT INTO opportunities VALUES (?, 7, ?, ?, 'p', 'EUR', NULL, 10.0, NULL, 1.5, 0.5, 0.25, 60.0, 'buy')", [(1, 2, "b"), (2, 1, "a")])
        db.executemany("INSERT INTO opportunities VALUES (?, 8, 1, 'lost', 'p', 'EUR', NULL, 10.0, NULL, 1.5, 0.5, 0.25, 60.0, 'buy')", [(3,)])
    history = History(spark, str(tmp_path / "h"))
    assert history.import_sqlite(file, rows=1) == 1
    assert (history.get_run(1).query, history.get_run(1).total_opportunities) == ("q", 2)
    assert [(r.rank, r.title, r.net_profit) for r in history.list_opportunities(1).collect()] == [(1, "a", 1.5), (2, "b", 1.5)]


def test_logs_and_credentials(capsys):
    from stallmark import logs

    for level in ("DEBUG", "ERROR", "INFO"):
        out = logs.configure(level)
    own = [h for h in out.handlers if isinstance(h, logs._PackageHandler)]
    assert len(own) == 1 and out.level == 20 and logs.logger("scan").name == "stallmark.scan"
    assert logs.fields(a=1, b=None, c="x y", d="z") == 'a=1 c="x y" d=z'
    out.removeHandler(own[0])
    out.propagate = True
    secret = live.Credentials("s", ("A", "B"), {"A": "hidden", "B": "too"})
    assert repr(secret) == "Credentials(A=***, B=***)" and secret["A"] == "hidden"
    with pytest.raises(http.SourceConfigError, match="B must be set"):
        live.Credentials("s", ("A", "B"), {"A": "x", "B": ""})


def test_many_queries_in_one_plan(spark):
    both = scan.scan(spark, "a 100", BUILT_IN[:2], 4).unionByName(scan.scan(spark, "b 200", BUILT_IN[:2], 4))
    items, _ = analyze_listings(both)
    assert {r.query: r.n for r in items.groupBy("query").agg(F.sum("group_size").alias("n")).collect()} == {"a 100": 8, "b 200": 8}


def test_schema_of_sources(spark):
    assert scan.search(spark, BUILT_IN[0], "x", 1).columns == LISTING.fieldNames()


def _rows(frame):
    def plain(x):
        if x is None or x != x:
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL | detail_queries.SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    known, sql = queries.QUERIES | detail_queries.QUERIES, queries.SQL | detail_queries.SQL
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    assert _rows(known[name](spark, sf_dir).toPandas()) == _rows(con.execute(sql[name]).df())


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).columns == ["query", "rank", "listing_id", "recommendation", "roi_percentage", "net_profit"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert queries.unicode_clean(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_grouping_of_parts(spark, sf_dir):
    from stallmark.functions.text import tokenize
    from stallmark.config import DeduplicationConfig
    from tests.test_operators import greedy

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", tokenize(F.concat_ws(" ", "p_name", "p_type")).alias("t")).collect()
    got = {}
    for r in queries.dedup_groups(spark, sf_dir).collect():
        got.setdefault(r.query, {})[r.leader] = r.group_size
    for brand in {r.p_brand for r in parts}:
        want = greedy([(f"{r.p_partkey:012d}", "parts", 0, r.t) for r in parts if r.p_brand == brand], DeduplicationConfig())
        sizes = {}
        for leader in want.values():
            sizes[leader[0]] = sizes.get(leader[0], 0) + 1
        assert got[brand] == sizes


def test_synthetic_format_equals_the_sources(spark):
    spark_sources.register(spark)
    df = spark.read.format("stallmark_synthetic").options(query=" rtx 4090 ", limit="25", parts="4").load()
    names = ["listing_id", "title", "provider", "url", "price", "currency", "location", "condition", "ordinal"]
    plain = scan.scan(spark, "rtx 4090", BUILT_IN, 25).select(*names).collect()
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(map(tuple, plain))
    assert df.rdd.getNumPartitions() == 16 and df.where("provider = 'ebay'").rdd.getNumPartitions() == 4
    some = df.where("ordinal >= 1000000003 and ordinal < 1000000009")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.ordinal for r in some.collect()) == [10**9 + i for i in range(3, 9)]
    assert df.where("ordinal > 5000000000").count() == 0 and df.where("ordinal = 2000000024 and provider = 'ebay'").count() == 0
    for wrong in ({"query": " "}, {"query": "x", "limit": "-1"}, {"query": "x", "parts": "0"}):
        with pytest.raises(Exception, match="must"):
            spark.read.format("stallmark_synthetic").options(**wrong).load().count()


def test_reader_prunes_by_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = spark_sources.SyntheticReader(None, "x", 100, 4)
    assert len(list(reader.pushFilters([EqualTo(("provider",), BUILT_IN[2].name), GreaterThan(("ordinal",), 2 * 10**9 + 30), LessThanOrEqual(("ordinal",), 2 * 10**9 + 60)]))) == 3
    assert [(p.source, p.start, p.stop) for p in reader.partitions()] == [(2, 31, 50), (2, 50, 61)]


def test_a_spark_format_is_a_source(spark):
    spark_sources.register(spark)
    source = spark_sources.SparkSource("made", "stallmark_synthetic", (("parts", "2"),))
    rows = scan.scan(spark, "x", [source], 5).collect()
    assert sorted(r.ordinal for r in rows) == [0, 1, 2, 3, 4] and {r.query for r in rows} == {"x"}


class Market:
    """A marketplace on this machine: pages of numbered items, the moments of all requests, and failures for some of them."""

    def reply(self, path, asked):
        """What is asked for (as noted in ``seen``), and the answer."""
        start, size = int(asked["offset"]), int(asked["limit"])
        items = [{"itemId": f"v{i}", "title": f"t {i}", "itemWebUrl": "u"} for i in range(start, min(start + size - self.short, self.total))]
        return start, {"total": self.total, "offset": start, "limit": size, "itemSummaries": items}

    def __init__(self, total, fail=(), short=0):
        import http.server
        import threading
        import time
        from urllib.parse import parse_qs, urlsplit

        market = self
        self.total, self.short = total, short
        self.seen, self.fail, self.lock, self.busy, self.most = [], set(fail), threading.Lock(), 0, 0

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
                start, answer = market.reply(urlsplit(self.path).path, asked)
                with market.lock:
                    market.seen.append((time.time(), start))
                    market.busy += 1
                    market.most = max(market.most, market.busy)
                    bad = start in market.fail
                    market.fail.discard(start)
                time.sleep(0.3)
                with market.lock:
                    market.busy -= 1
                body = json.dumps(answer).encode()
                self.send_response(503 if bad else 200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_pages_are_read_in_parallel(spark):
    spark_sources.register(spark)
    market = Market(95, fail=(40,))
    df = spark.read.format("stallmark_pages").options(base_url=market.url, query="x", limit="1000", page_size="10").load()
    rows = marketplace_json.search_listings(df).select("listing_id").collect()
    assert [r.listing_id for r in rows] == [f"v{i}" for i in range(95)]  # in the order of the pages
    market.server.shutdown()
    starts = [s for _, s in market.seen]
    assert market.most > 1 and starts.count(40) == 2 and set(starts) == set(range(0, 100, 10))
    few = Market(95)
    df = spark.read.format("stallmark_pages").options(base_url=few.url, query="x", limit="15", page_size="10").load()
    assert df.count() == 2
    few.server.shutdown()


def test_a_rate_holds_for_all_pages_together(spark):
    spark_sources.register(spark)
    market = Market(60, fail=(20,))
    df = spark.read.format("stallmark_pages").options(base_url=market.url, query="x", limit="60", page_size="10", rate="4").load()
    assert sorted(r.page for r in df.collect()) == list(range(6))
    market.server.shutdown()
    at = sorted(t for t, s in market.seen if s)
    assert len(at) == 6 and all(b - a > 0.15 for a, b in zip(at, at[1:], strict=False))
    lease = [spark_sources.Lease(100.0, 2.0, p, 5).at(k) for k in range(3) for p in range(5)]
    assert lease == [100.0 + i / 2 for i in range(15)] and spark_sources.Lease(0, None, 3, 5).at(2) == 0


def test_page_reader_refuses_odd_options_and_answers(spark):
    spark_sources.register(spark)
    for wrong in ({"query": "x"}, {"base_url": "http://127.0.0.1:1", "query": " "}, {"base_url": "http://127.0.0.1:1", "query": "x", "page_size": "0"}):
        with pytest.raises(Exception, match="must"):
            spark.read.format("stallmark_pages").options(**wrong).load().count()
    with pytest.raises(Exception, match="no connection"):
        spark.read.format("stallmark_pages").options(base_url="http://127.0.0.1:9", query="x", max_attempts="1").load().count()


class Catalog(Market):
    """A catalog: pages of products, p3 twice, and the market data of each but p5, which fails for good."""

    def reply(self, path, asked):
        if path.endswith("market-data"):
            product = path.split("/")[-2]
            self.fail |= {"p5"}
            return product, [{"productId": product, "variantId": "a", "lowestAskAmount": product[1:] + "0"}] if product != "p7" else {"odd": 1}
        page, size = int(asked["pageNumber"]), int(asked["pageSize"])
        names = ["p3", *(f"p{i}" for i in range(self.total - 1))]
        products = [{"productId": n, "title": "Shoe " + n} for n in names[(page - 1) * size : page * size]]
        return page, {"count": self.total, "pageNumber": page, "pageSize": size, "hasNextPage": page * size < self.total, "products": products}


def test_slots_of_all_tasks_keep_the_rate():
    now = [100.0]
    times = []
    for place in range(3):
        now[0] = 100.0 + place * 0.7  # tasks begin at different moments
        slots = requests.Slots(100.0, 4.0, place, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        for k in range(5):
            slots.acquire()
            times.append(round((now[0] - 100.0) * 4))
            now[0] += 2.0 if k == 2 else 0.01  # a slow answer loses its slots, and takes no one else's
    assert len(set(times)) == 15 and {t % 3 for t in times[:5]} == {0} and {t % 3 for t in times[10:]} == {2}


@pytest.mark.parametrize("total, limit, short, fail", [(95, 1000, 0, (40,)), (60, 30, 3, ()), (8, 50, 0, ()), (95, 25, 0, ())])
def test_connectors_read_pages_by_tasks(spark, total, limit, short, fail):
    got = {}
    for tasks in (1, None):
        market = Market(total, fail, short)
        source = live.live_source("ebay_browse", {"base_url": market.url, "page_size": 10, "max_results": 1000, "retry": {"backoff_base": 0.01}}, env=SECRETS, token_transport=Wire(TOKEN), tasks=tasks)
        assert source.tasks == tasks or source.tasks == 4
        got[tasks] = [r.listing_id for r in scan.search(spark, source, "x", limit).collect()]
        asked = sorted(s for _, s in market.seen)
        got[f"pages {tasks}"] = asked
        market.server.shutdown()
        assert tasks is not None or total < 50 or market.most > 1
    assert got[1] == got[None] and len(got[1]) == min(total, limit) and got["pages 1"] == got["pages None"]


def test_pages_by_tasks_keep_the_rate_and_fail_the_source(spark):
    market = Market(60, fail=(20,))
    settings = {"base_url": market.url, "page_size": 10, "max_results": 60, "rate_limit_per_second": 5.0, "retry": {"backoff_base": 0.01}}
    assert live.live_source("ebay_browse", settings, env=SECRETS, token_transport=Wire(TOKEN)).fetch(spark, "x", 60).count() == 60
    at = sorted(t for t, s in market.seen if s)
    assert len(at) == 6 and all(b - a > 0.1 for a, b in zip(at, at[1:], strict=False))
    market.fail |= {30}
    source = live.live_source("ebay_browse", settings | {"retry": {"max_attempts": 1}}, env=SECRETS, token_transport=Wire(TOKEN))
    with pytest.raises(http.RequestError, match="page 4: HTTP 503"):
        source.fetch(spark, "x", 60)
    market.server.shutdown()


def test_look_ups_by_tasks(spark, tmp_path):
    kept = http.TokenFile(tmp_path / "t.json")
    kept.save({"refresh_token": "r"})
    got = {}
    for tasks in (1, 3):
        market = Catalog(31)
        settings = {"base_url": market.url, "page_size": 10, "max_results": 25, "retry": {"max_attempts": 1}}
        source = live.live_source("stockx", settings, env=SECRETS, token_transport=Wire(TOKEN), tokens=kept, tasks=tasks)
        got[tasks] = [(r.listing_id, r.price) for r in source.fetch(spark, "shoe", 25).collect()]
        market.server.shutdown()
        looked = [s for _, s in market.seen if isinstance(s, str)]
        assert sorted(looked) == sorted({f"p{i}" for i in range(29)}) and (tasks == 1 or market.most > 1)
    assert sorted(got[1]) == sorted(got[3]) and len(got[3]) == 25
    assert [n for n, _ in got[3] if n != "p3"] == [f"p{i}" for i in range(24) if i != 3]
    prices = dict(got[3])
    assert prices["p5"] is None and prices["p7"] is None and prices["p3"] == 30.0 and prices["p12"] == 120.0


def test_answers_of_odd_requests(spark):
    rows = spark.createDataFrame([(None, "http://127.0.0.1:9/", None)], "key string, url string, params map<string,string>")
    assert requests.answers(rows, headers={}, tasks=2).count() == 0
    rows = spark.createDataFrame([("a", "http://127.0.0.1:9/", None)] * 3 + [("b", "http://127.0.0.1:9/", {"q": "1"})], rows.schema)
    got = requests.answers(rows, headers={}, tasks=2, retry=http.RetryPolicy(max_attempts=2, backoff_base=0.0)).orderBy("key").collect()
    assert [(r.key, r.text, r.status, r.sent) for r in got] == [("a", None, None, 2), ("b", None, None, 2)] and "no connection" in got[0].error
    with pytest.raises(ValueError):
        requests.answers(rows, headers={}, tasks=0)
