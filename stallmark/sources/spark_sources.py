"""Sources of listings as Spark data sources, for ``spark.read.format(...)``.

``stallmark_synthetic`` makes the rows of the built-in sources in as many partitions as wanted;
a filter on ``ordinal`` or ``provider`` leaves out what cannot pass. ``stallmark_pages`` reads the JSON pages of a
marketplace's search: the driver asks for the first page alone, which tells how many there are, and each further
page is a partition. A rate limit holds for all of them together: every request has a moment of its own
(``Lease``), also when it is a second attempt, so that tasks need not talk to each other.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..shared import send_package
from .http import BadStatus, Request, RequestError, ResponseError, RetryPolicy, SourceConfigError, send_with_urllib
from .synthetic import BUILT_IN, SyntheticSource

_SYNTHETIC = "listing_id string, title string, provider string, url string, price double, currency string, location string, condition string, rank string, ordinal bigint"
CONDITIONS = ("new", "used", "refurbished")


@dataclass
class Range(InputPartition):
    source: int
    start: int
    stop: int


def synthetic_row(source: SyntheticSource, query: str, i: int) -> tuple:
    """Row i of a source for a query, from the hash that ``SyntheticSource`` takes too."""
    digits = hashlib.sha256(f"{source.name}|{query}|{i}".encode()).hexdigest()[:8]
    seed = int(digits, 16)
    price = round(50 + seed % 195000 / 100, 2)
    return (f"{source.name}-{digits}", f"{query.title()} - {source.name} listing #{i + 1}", source.name, f"{source.base_url}/item/{digits}", price, source.currency, source.locations[seed % len(source.locations)], CONDITIONS[seed % 3], str(i))


class SyntheticReader(DataSourceReader):
    def __init__(self, schema, query: str, limit: int, parts: int):
        self.schema, self.query, self.limit, self.parts = schema, query, limit, parts
        self.low, self.high, self.provider = 0, len(BUILT_IN) * 10**9, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the ranges; Spark filters the rows all the same."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("provider",) and isinstance(f, EqualTo):
                self.provider = value
            elif column == ("ordinal",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, value + 1 - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Range]:
        each, out = math.ceil(self.limit / self.parts) or 1, []
        for k, source in enumerate(BUILT_IN):
            if self.provider is None or self.provider == source.name:
                for a in range(0, self.limit, each):
                    start, stop = max(a, self.low - k * 10**9), min(a + each, self.limit, self.high - k * 10**9)
                    if start < stop:
                        out.append(Range(k, start, stop))
        return out or [Range(0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split(" ")[0], {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[c.split(" ")[1]]) for c in _SYNTHETIC.split(", ")])
        for a in range(part.start, part.stop, 10_000):
            rows = [(*synthetic_row(BUILT_IN[part.source], self.query, i), part.source * 10**9 + i) for i in range(a, min(a + 10_000, part.stop))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class SyntheticListings(DataSource):
    """Options: query, limit (rows of each source), parts (partitions of each source)."""

    @classmethod
    def name(cls) -> str:
        return "stallmark_synthetic"

    def schema(self) -> str:
        return _SYNTHETIC

    def reader(self, schema) -> DataSourceReader:
        query = self.options.get("query", "").strip()
        if not query:
            raise SourceConfigError("query must not be empty")
        limit, parts = int(self.options.get("limit", "10")), int(self.options.get("parts", "1"))
        if limit < 0 or parts < 1:
            raise SourceConfigError("limit must not be negative, parts must be positive")
        return SyntheticReader(schema, query, limit, parts)


@dataclass(frozen=True)
class Lease:
    """When the requests of one page may be sent: attempt k of page p at start + (k * pages + p) / rate."""

    start: float
    rate: float | None
    page: int
    pages: int

    def at(self, attempt: int) -> float:
        return self.start + (attempt * self.pages + self.page) / self.rate if self.rate else 0.0


@dataclass
class Page(InputPartition):
    number: int
    params: dict[str, str]
    lease: Lease
    #: The page itself, where the driver has it already.
    text: str | None = None


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = options.get
        self.url, self.query = urljoin(get("base_url", ""), get("path", "/buy/browse/v1/item_summary/search")), get("query", "").strip()
        if not self.query or not get("base_url"):
            raise SourceConfigError("query and base_url must not be empty")
        self.limit, self.size = int(get("limit", "50")), int(get("page_size", "20"))
        if self.limit < 1 or self.size < 1:
            raise SourceConfigError("limit and page_size must be positive")
        self.rate = float(get("rate")) if get("rate") else None
        self.timeout, self.retry = float(get("timeout", "10")), RetryPolicy(max_attempts=int(get("max_attempts", "3")))
        self.headers = json.loads(get("headers", "{}"))

    def params(self, page: int) -> dict[str, str]:
        return {"q": self.query[:100], "limit": str(self.size), "offset": str(page * self.size)}

    def fetch(self, params: dict[str, str], lease: Lease) -> str:
        for attempt in range(self.retry.max_attempts):
            if (wait := lease.at(attempt) - time.time()) > 0:
                time.sleep(wait)
            try:
                answer = send_with_urllib(Request(self.url, params, self.headers, timeout=self.timeout))
                if not 200 <= answer.status < 300:
                    raise BadStatus(answer.status)
                return answer.body.decode()
            except RequestError as e:
                if attempt + 1 == self.retry.max_attempts or not self.retry.again(e):
                    raise
                time.sleep(max(self.retry.delay(attempt + 1), getattr(e, "retry_after", None) or 0.0) if not self.rate else (getattr(e, "retry_after", None) or 0.0))
        raise AssertionError("unreachable")

    def partitions(self) -> list[Page]:
        now = time.time()
        text = self.fetch(self.params(0), Lease(now, self.rate, 0, 1))
        try:
            data = json.loads(text)
        except ValueError as e:
            raise ResponseError("not JSON") from e
        if not isinstance(data, dict):
            raise ResponseError("expected a JSON object")
        total = data.get("total")
        known = total if isinstance(total, int) and not isinstance(total, bool) else len(data.get("itemSummaries") or ())
        pages = max(1, math.ceil(min(known, self.limit) / self.size))
        start = time.time() + (1 / self.rate if self.rate else 0.0)
        return [Page(0, {}, Lease(0.0, None, 0, 1), text), *(Page(p, self.params(p), Lease(start, self.rate, p - 1, pages - 1)) for p in range(1, pages))]

    def read(self, part: Page) -> Iterator[tuple[int, str]]:
        yield part.number, self.fetch(part.params, part.lease) if part.text is None else part.text


class ListingPages(DataSource):
    """Options: base_url, query, limit, page_size, and path, rate (requests a second), timeout, max_attempts, headers (JSON). A row for each page."""

    @classmethod
    def name(cls) -> str:
        return "stallmark_pages"

    def schema(self) -> str:
        return "page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters pushed down, and the package to its executors."""
    send_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyntheticListings)
    spark.dataSource.register(ListingPages)


@dataclass(frozen=True)
class SparkSource:
    """Any Spark format as a source of a scan: it gets the query and the limit as options and has the columns of a listing."""

    name: str
    format: str
    options: tuple[tuple[str, str], ...] = ()

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        rows = spark.read.format(self.format).options(**dict(self.options), query=query, limit=str(limit)).load()
        have = set(rows.columns)
        none = {"posted_at": F.lit(None).cast("timestamp"), "scanned_at": F.current_timestamp(), "extra": F.create_map().cast("map<string,string>")}
        return rows.withColumns({k: v for k, v in none.items() if k not in have})
