"""Live marketplace connectors: they fetch JSON pages, Spark turns them into listings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import http
from .http import Client, RequestError, ResponseError, RetryPolicy, SourceConfigError, TokenBucket, TokenFile, Transport, check_url, send_with_urllib
from .marketplace_json import catalog_listings, catalog_products, search_listings
from .requests import answers


@dataclass(frozen=True)
class Capabilities:
    """What a marketplace offers; filters and sorting are named but never sent."""

    supports_pagination: bool = True
    supports_price_filter: bool = False
    supports_condition_filter: bool = False
    supports_sorting: bool = False
    max_page_size: int = 50
    max_results: int | None = None
    currencies: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.max_page_size <= 0 or (self.max_results is not None and self.max_results <= 0):
            raise ValueError("page and result caps must be positive")


@dataclass(frozen=True)
class LiveConfig:
    base_url: str
    timeout: float = 10.0
    page_size: int = 20
    max_results: int = 50
    user_agent: str = "stallmark/1"
    default_currency: str = "EUR"
    rate_limit_per_second: float | None = None
    rate_limit_burst: int = 1
    #: Tasks that send requests side by side, with no burst; 1 leaves all requests to the driver.
    parallel: int = 4
    retry: RetryPolicy = RetryPolicy()
    extra_headers: dict[str, str] = field(default_factory=dict)
    oauth_token_url: str = ""
    oauth_scope: str = ""
    marketplace_id: str = ""
    currency_code: str = "USD"

    def __post_init__(self) -> None:
        check_url(self.base_url, "base_url")
        check_url(self.oauth_token_url, "oauth_token_url")
        for name in ("timeout", "page_size", "max_results", "rate_limit_burst", "parallel"):
            if getattr(self, name) <= 0:
                raise SourceConfigError(f"{name} must be positive")
        if self.rate_limit_per_second is not None and self.rate_limit_per_second <= 0:
            raise SourceConfigError("rate_limit_per_second must be positive when set")
        for name in ("oauth_scope", "currency_code"):
            if not getattr(self, name):
                raise SourceConfigError(f"{name} must not be empty")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any], defaults: Mapping[str, Any]) -> LiveConfig:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(data) - known):
            raise SourceConfigError(f"unknown config key(s): {', '.join(unknown)}")
        values = dict(defaults) | dict(data)
        if isinstance(retry := values.get("retry"), Mapping):
            if unknown := sorted(set(retry) - {f.name for f in fields(RetryPolicy)}):
                raise SourceConfigError(f"unknown retry config key(s): {', '.join(unknown)}")
            values["retry"] = RetryPolicy(**{k: frozenset(v) if k == "retry_on_status" else v for k, v in retry.items()})
        try:
            return cls(**values)
        except TypeError as e:
            raise SourceConfigError(str(e)) from e


def pages(fetch: Callable[[int], dict], count: Callable[[dict], int], more: Callable[[dict], bool], max_results: int, max_pages: int | None = None) -> Iterator[dict]:
    """Pages from 1 on until there are no more, or enough results."""
    got, page = 0, 1
    while got < max_results:
        data = fetch(page)
        yield data
        got += count(data)
        if not more(data) or page == max_pages:
            return
        page += 1


def _object(data: object) -> dict:
    if not isinstance(data, dict):
        raise ResponseError("expected a JSON object")
    return data


def _whole(*values: object) -> bool:
    return all(isinstance(v, int) and not isinstance(v, bool) for v in values)


#: What to ask for: an address and its parameters.
Asked = tuple[str, dict[str, str]]


@dataclass
class LiveSource:
    """A connector. The first page is read by the driver; with ``tasks`` above 1 the further pages and the look-ups
    are sent by that many tasks (see ``requests``), else by the driver one after the other."""

    config: LiveConfig
    client: Client
    name: str = ""
    capabilities: Capabilities = Capabilities()
    tasks: int = 1

    #: Longest query that is sent.
    max_query = 100
    #: The list of results in a page, and headers of its own.
    listed = ""

    def sizes(self, limit: int) -> tuple[int, int]:
        """Results and page size, within the caps of the configuration and the marketplace."""
        most = min(limit, self.config.max_results, self.capabilities.max_results or limit)
        return max(1, most), min(self.config.page_size, self.capabilities.max_page_size)

    def read_pages(self, spark: SparkSession, query: str, limit: int) -> tuple[DataFrame, int]:
        """``page, text`` of the pages, and how many results to keep.

        Pages are asked for until there are no more or enough results. Once the first tells how many results there are, the tasks get
        the pages that they fill; if those hold fewer results than they should, the rest is read one by one.
        """
        most, size = self.sizes(limit)
        texts: list[tuple[int, str]] = []

        def one(page: int) -> dict:
            address, params = self.asked(query[: self.max_query], page, size)
            answer = self.client.get(address, params, self.headers())
            texts.append((page, answer.body.decode()))
            return _object(answer.json())

        last = one(1)
        got, done, dealt = self.count(last), 1, None
        total = self.total(last)
        if self.tasks > 1 and self.capabilities.supports_pagination and got < most and total is not None and self.more(last):
            done = max(1, -(-min(total, most) // size))
            if done > 1:
                dealt = self._dealt(spark, [(p, *self.asked(query[: self.max_query], p, size)) for p in range(2, done + 1)])
                got += dealt.agg(F.sum(F.coalesce(F.expr(f"json_array_length(get_json_object(text, '$.{self.listed}'))"), F.lit(0)))).first()[0]
                last = _object(http.Response(200, dealt.where(F.col("page") == done).first().text.encode()).json())
        while got < most and self.capabilities.supports_pagination and self.more(last):
            done += 1
            last = one(done)
            got += self.count(last)
        frame = spark.createDataFrame(texts, "page int, text string")
        return frame if dealt is None else frame.unionByName(dealt), most

    def _dealt(self, spark: SparkSession, asked: list[tuple[int, str, dict[str, str]]]) -> DataFrame:
        rows = spark.createDataFrame([(str(p), a, q) for p, a, q in asked], "key string, url string, params map<string,string>")
        got = self._answers(rows)
        if bad := got.where("text is null").orderBy("key").first():
            raise BadPage(int(bad.key), bad.error, self.name)
        return got.select(F.col("key").cast("int").alias("page"), "text")

    def _answers(self, rows: DataFrame) -> DataFrame:
        c = self.config
        return answers(rows, headers=self.client.all_headers(self.headers()), tasks=self.tasks, rate=c.rate_limit_per_second, retry=c.retry, timeout=c.timeout, transport=self.client.transport)

    def headers(self) -> dict[str, str]:
        return {}

    def asked(self, query: str, page: int, size: int) -> Asked:
        raise NotImplementedError

    def count(self, data: dict) -> int:
        return len(data.get(self.listed) or ())

    def total(self, data: dict) -> int | None:
        raise NotImplementedError

    def more(self, data: dict) -> bool:
        raise NotImplementedError

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        raise NotImplementedError


class BadPage(RequestError):
    """A page that a task did not get."""

    def __init__(self, page: int, error: str, source: str):
        super().__init__(f"page {page}: {error}", source=source)


class SearchSource(LiveSource):
    """Item summaries of a marketplace's search."""

    listed = "itemSummaries"

    def headers(self) -> dict[str, str]:
        return {"X-EBAY-C-MARKETPLACE-ID": self.config.marketplace_id}

    def asked(self, query: str, page: int, size: int) -> Asked:
        return urljoin(self.config.base_url, "/buy/browse/v1/item_summary/search"), {"q": query, "limit": str(size), "offset": str((page - 1) * size)}

    def total(self, data: dict) -> int | None:
        return data["total"] if _whole(data.get("total")) else None

    def more(self, data: dict) -> bool:
        total, offset, size = data.get("total"), data.get("offset"), data.get("limit")
        return bool(isinstance(data.get("next"), str) and data["next"]) or (_whole(total, offset, size) and offset + size < total)

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        pages, most = self.read_pages(spark, query, limit)
        out = search_listings(pages.orderBy("page"), provider=self.name, default_currency=self.config.default_currency).limit(most)
        # Parsed here, so that a malformed page fails this source and not a later stage.
        return spark.createDataFrame(out.collect(), out.schema)


class CatalogSource(LiveSource):
    """Products of a catalog, with the market data of each."""

    listed = "products"

    def asked(self, query: str, page: int, size: int) -> Asked:
        return urljoin(self.config.base_url, "/v2/catalog/search"), {"query": query, "pageNumber": str(page), "pageSize": str(size)}

    def total(self, data: dict) -> int | None:
        return data["count"] if _whole(data.get("count")) else None

    def more(self, data: dict) -> bool:
        if isinstance(data.get("hasNextPage"), bool):
            return data["hasNextPage"]
        page, size, count = data.get("pageNumber"), data.get("pageSize"), data.get("count")
        return _whole(page, size, count) and page * size < count

    def market_data(self, spark: SparkSession, products: DataFrame) -> DataFrame:
        """``product_id, text`` of the market data of each product, asked for once; a failure leaves the product out."""
        address = urljoin(self.config.base_url, "/v2/catalog/products/")
        if self.tasks > 1:
            params = F.create_map(F.lit("currencyCode"), F.lit(self.config.currency_code))
            rows = products.select(F.col("product_id").alias("key"), F.concat(F.lit(address), "product_id", F.lit("/market-data")).alias("url"), params.alias("params"))
            return self._answers(rows).where("json_array_length(text) is not null").select(F.col("key").alias("product_id"), "text")

        def one(product: str) -> str | None:
            try:
                answer = self.client.get(f"{address}{product}/market-data", {"currencyCode": self.config.currency_code})
                return answer.body.decode() if isinstance(answer.json(), list) else None
            except http.SourceError:
                return None

        found = [(r.product_id, one(r.product_id)) for r in products.collect()]
        return spark.createDataFrame([x for x in found if x[1] is not None], "product_id string, text string")

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        pages, most = self.read_pages(spark, query, limit)
        products = catalog_products(pages).groupBy("product_id").agg(F.min(F.struct("page", "place")).alias("at"))
        out = catalog_listings(pages, self.market_data(spark, products.orderBy("at").select("product_id")), provider=self.name, currency=self.config.currency_code)
        at = {r.product_id: tuple(r.at) for r in products.collect()}
        # At most a page more than ``most``; the join does not keep their order.
        rows = sorted(out.collect(), key=lambda r: at[r.listing_id])[:most]
        return spark.createDataFrame(rows, out.schema)


@dataclass(frozen=True)
class LiveKind:
    source: type[LiveSource]
    capabilities: Capabilities
    defaults: dict[str, Any]
    secrets: tuple[str, ...]


# The connectors, their addresses, caps and the environment variables of their credentials.
LIVE = {
    "ebay_browse": LiveKind(
        SearchSource,
        Capabilities(supports_price_filter=True, supports_condition_filter=True, supports_sorting=True, max_page_size=200, max_results=10_000),
        {"base_url": "https://api.ebay.com", "oauth_token_url": "https://api.ebay.com/identity/v1/oauth2/token", "oauth_scope": "https://api.ebay.com/oauth/api_scope", "marketplace_id": "EBAY_IE"},
        ("EBAY_CLIENT_ID", "EBAY_CLIENT_SECRET"),
    ),
    "stockx": LiveKind(
        CatalogSource,
        Capabilities(max_page_size=50),
        {"base_url": "https://api.stockx.com", "oauth_token_url": "https://accounts.stockx.com/oauth/token", "oauth_scope": "openid offline_access"},
        ("STOCKX_API_KEY", "STOCKX_CLIENT_ID", "STOCKX_CLIENT_SECRET"),
    ),
}


def check_live_settings(tables: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """The ``providers`` tables of a configuration file, checked but without credentials."""
    from ..config import ConfigError

    for name, table in tables.items():
        if not isinstance(table, Mapping):
            raise ConfigError(f"[providers.{name}] must be a table")
        if name not in LIVE:
            raise ConfigError(f"[providers.{name}] unknown live provider; registered: {', '.join(sorted(LIVE))}")
        if not isinstance(table.get("enabled", True), bool):
            raise ConfigError(f"[providers.{name}] 'enabled' must be a boolean")
        try:
            LiveConfig.from_dict({k: v for k, v in table.items() if k != "enabled"}, LIVE[name].defaults)
        except SourceConfigError as e:
            raise ConfigError(f"[providers.{name}] {e}") from e
    return {name: dict(table) for name, table in tables.items()}


class Credentials:
    """The secrets of a source from the environment (all of them, or an error that names the missing ones); never shown by repr."""

    def __init__(self, source: str, names: tuple[str, ...], env: Mapping[str, str]):
        if missing := [n for n in names if not env.get(n)]:
            raise SourceConfigError(f"{', '.join(missing)} must be set", source=source)
        self._values = {n: env[n] for n in names}

    def __getitem__(self, name: str) -> str:
        return self._values[name]

    def __repr__(self) -> str:
        return f"Credentials({', '.join(f'{n}=***' for n in self._values)})"


def live_source(name: str, settings: Mapping[str, Any], *, env: Mapping[str, str] | None = None, transport: Transport = send_with_urllib, token_transport: Transport = send_with_urllib, tokens: TokenFile | None = None, tasks: int | None = None, **client: Any) -> LiveSource:
    """A connector with credentials from the environment; without them nothing is built."""
    if name not in LIVE:
        raise SourceConfigError(f"unknown live source {name!r}")
    kind, env = LIVE[name], os.environ if env is None else env
    config = LiveConfig.from_dict(settings, kind.defaults)
    secret = Credentials(name, tuple(kind.secrets), env)
    headers = {"User-Agent": config.user_agent, "Accept": "application/json"} | config.extra_headers
    options = {"transport": token_transport, "timeout": config.timeout}
    if name == "stockx":
        tokens = tokens or TokenFile(os.path.expanduser("~/.stallmark/stockx.json"))
        kept = tokens.load().get("refresh_token")
        if not isinstance(kept, str) or not kept:
            raise SourceConfigError(f"no refresh token in {tokens.path}; log in outside of this package and save it there", source=name)
        auth = http.refresh_token(config.oauth_token_url, secret["STOCKX_CLIENT_ID"], secret["STOCKX_CLIENT_SECRET"], kept, config.oauth_scope, on_token=tokens.save, **options)
        headers["x-api-key"] = secret["STOCKX_API_KEY"]
    else:
        auth = http.client_credentials(config.oauth_token_url, secret["EBAY_CLIENT_ID"], secret["EBAY_CLIENT_SECRET"], config.oauth_scope, **options)
    # What is injected stays on the driver, unless it says how many tasks may have it.
    tasks = config.parallel if tasks is None and transport is send_with_urllib and not client else tasks or 1
    limiter = TokenBucket(config.rate_limit_per_second, config.rate_limit_burst) if config.rate_limit_per_second else None
    return kind.source(config, Client(headers=headers, auth=auth, transport=transport, retry=config.retry, limiter=limiter, timeout=config.timeout, **client), name, kind.capabilities, tasks)
