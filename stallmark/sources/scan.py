"""Union-all scan over sources, with a limit for each."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PipelineConfig, ScannerConfig
from ..logs import fields, logger
from ..schemas import LISTING
from .synthetic import BUILT_IN

log = logger("scan")


class Source(Protocol):
    """What a source has to offer; a DataFrame with the columns of LISTING."""

    name: str

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame: ...


_REGISTRY: dict[str, Source] = {}


def register_source(source: Source) -> None:
    """Make a source known by its name; a name may be taken once."""
    if not source.name:
        raise ValueError("a source needs a name")
    if source.name in _REGISTRY:
        raise ValueError(f"source {source.name!r} is already registered")
    _REGISTRY[source.name] = source


def source_named(name: str) -> Source:
    if name not in _REGISTRY:
        raise KeyError(f"unknown source {name!r}; registered: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


for _source in BUILT_IN:
    register_source(_source)


def search(spark: SparkSession, source: Source, query: str, limit: int) -> DataFrame:
    """At most ``limit`` listings of one source for a query that is not blank."""
    return numbered_search(spark, source, query, limit).drop("ordinal")


def numbered_search(spark: SparkSession, source: Source, query: str, limit: int) -> DataFrame:
    """``search`` with the place of each listing, from 0 on, in ``ordinal``."""
    if not query.strip():
        raise ValueError("query must not be empty")
    if limit <= 0:
        raise ValueError("limit must be positive")
    # The limit bounds what the one sorting task holds.
    rows = source.fetch(spark, query.strip(), limit).select(*LISTING.fieldNames()).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_at")) - 1
    return rows.orderBy("_at").limit(limit).withColumn("ordinal", place.cast("long")).drop("_at")


def scan(spark: SparkSession, query: str, sources: Iterable[Source], limit: int = 10) -> DataFrame:
    """Listings of all sources in their order, with ``query`` and ``ordinal``.

    A source that fails is logged and left out. Connectors read their pages
    before they return, so that such a failure shows here and not in a later stage.
    """
    if not query or not query.strip():
        raise ValueError("query must not be empty")
    parts = []
    for place, source in enumerate(sources):
        try:
            part = numbered_search(spark, source, query, limit)
        except Exception:
            log.exception("source failed %s", fields(source=source.name, query=query, limit=limit))
            continue
        parts.append(part.withColumn("ordinal", F.lit(place * 1_000_000_000).cast("long") + F.col("ordinal")))
    if not parts:
        empty = spark.createDataFrame([], LISTING).withColumn("ordinal", F.lit(0).cast("long"))
        return empty.withColumn("query", F.lit(query))
    return reduce(DataFrame.unionByName, parts).withColumn("query", F.lit(query))


def configured_sources(config: PipelineConfig, **live_options) -> list[Source]:
    """The sources that a configuration names; switched-off live ones are left out, unknown names are errors."""
    from .live import LIVE, live_source

    out: list[Source] = []
    for name in config.scanner.providers:
        if name in LIVE:
            settings = dict(config.live_providers.get(name, {}))
            if settings.pop("enabled", True):
                out.append(live_source(name, settings, **live_options))
            else:
                log.info("live source is disabled %s", fields(source=name))
        else:
            out.append(source_named(name))
    return out


def scan_limit(config: PipelineConfig) -> int:
    return config.scanner.max_results_per_provider if config.scan_limit is None else config.scan_limit


def default_sources(config: ScannerConfig | None = None) -> list[Source]:
    return [source_named(n) for n in (config or ScannerConfig()).providers]
