"""The listing pipeline: scan, normalize, classify, group, price, recommend, score, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.terms import classify_title
from ..operators import deduplicate, normalize, opportunity, pricing, ranking
from ..sources.scan import Source, configured_sources, scan, scan_limit

ITEM = (
    "recommendation", "title", "provider", "currency", "asking_price", "estimated_market_price", "gross_profit", "net_profit",
    "roi_percentage", "margin_percentage", "confidence_score", "recommendation_score", "risk_score", "comparable_count", "group_size", "reasons",
)


@dataclass(frozen=True)
class Result:
    """The ranked items of a query (a DataFrame), and its listings with their classes and groups."""

    query: str
    items: DataFrame
    listings: DataFrame

    def total_listings(self) -> int:
        return self.listings.count()

    def total_groups(self) -> int:
        return self.items.count()

    def counts(self) -> dict[str, int]:
        return {r.recommendation: r.n for r in ranking.counts_by_recommendation(self.items).collect()}

    def actionable(self) -> DataFrame:
        return ranking.actionable(self.items)


def analyze_listings(listings: DataFrame, config: PipelineConfig | None = None, *, searched: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, listings) of listings with ``query`` and ``ordinal``; many queries run in one plan.

    With ``searched``, the one query that was searched for, listings have their ``classification`` too.
    """
    c = config or PipelineConfig()
    normal = normalize.normalize(listings, c.normalization)
    if searched is not None:
        normal = normal.withColumn("classification", classify_title(F.col("n_title"), searched, c.classification))
    grouped = deduplicate.assign_groups(normal, c.deduplication)
    keys = ["query", "leader"]
    groups = deduplicate.canonical(grouped, c.deduplication)
    prices = pricing.market_prices(pricing.comparables(grouped).select(*keys, "price", "currency", "weight"), keys, c.pricing)
    priced = pricing.attach_prices(groups, prices, keys, c.pricing)
    flat = priced.select(*keys, "group_size", "fingerprint", "is_duplicate", "providers", "market", F.col("market.comparable_count").alias("comparable_count"), *(F.col(f"c.{x}").alias(x) for x in ("listing_id", "title", "provider", "price", "currency")))
    scored = opportunity.score(opportunity.analyze(flat, c.opportunity), c.scoring)
    return ranking.with_rank(scored), grouped


class Pipeline:
    """The pipeline for one query at a time, with configured or given sources."""

    def __init__(self, spark: SparkSession, config: PipelineConfig | None = None, *, sources: list[Source] | None = None):
        self.spark, self.config = spark, config or PipelineConfig()
        self.sources = configured_sources(self.config) if sources is None else sources

    def analyze(self, query: str) -> Result:
        listings = scan(self.spark, query, self.sources, scan_limit(self.config))
        return Result(query, *analyze_listings(listings, self.config, searched=query))
