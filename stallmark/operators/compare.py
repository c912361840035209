"""What changed between two runs: a full outer join on the identity of an opportunity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ComparisonConfig
from ..functions.rounding import fixed, money
from ..functions.text import identity_key
from ..schemas import CHANGE_ORDER, CHANGES
from .ranking import counts_by

#: Metrics in the order in which they decide, and whether more is better.
METRICS = (("recommendation_score", True), ("roi_percentage", True), ("net_profit", True), ("confidence_score", True), ("risk_score", False))


def best_by_key(df: DataFrame) -> DataFrame:
    """One row for each identity key: the best rank (of equal ones, the first by title)."""
    keyed = df.withColumn("key", identity_key(F.col("provider"), F.col("title")))
    return keyed.groupBy("key").agg(F.min_by(F.struct(*df.columns), F.struct("rank", "title", "provider")).alias("o"))


def compare(old: DataFrame, new: DataFrame, config: ComparisonConfig | None = None) -> DataFrame:
    """(category, key, provider, title, reason, <metric>_old, <metric>_new, <metric>_delta), for each key of either run."""
    c = config or ComparisonConfig()
    both = best_by_key(old).withColumnRenamed("o", "a").join(best_by_key(new).withColumnRenamed("o", "b"), "key", "full_outer")
    value = lambda side, m: F.coalesce(F.col(f"{side}.{m}"), F.lit(0.0))
    delta = {m: value("b", m) - value("a", m) for m, _ in METRICS}
    fresh, gone = F.col("a").isNull(), F.col("b").isNull()
    category = F.when(fresh, "new").when(gone, "disappeared")
    reason: Column = F.when(fresh, F.lit("new opportunity")).when(gone, F.lit("no longer present"))
    for m, more in METRICS:
        moved, better = F.abs(delta[m]) > c.epsilon, delta[m] > 0 if more else delta[m] < 0
        category = category.when(moved, F.when(better, "improved").otherwise("worsened"))
        reason = reason.when(moved, F.concat(F.lit(f"{m} "), fixed(value("a", m)), F.lit(" -> "), fixed(value("b", m)), F.lit(" ("), fixed(delta[m], signed=True), F.lit(")")))
    category, reason = category.otherwise("unchanged"), reason.otherwise("no change in key metrics")
    cells = [x for m, _ in METRICS for x in (F.col(f"a.{m}").alias(f"{m}_old"), F.col(f"b.{m}").alias(f"{m}_new"), money(delta[m], 6).alias(f"{m}_delta"))]
    return both.select(category.alias("category"), "key", F.coalesce("b.provider", "a.provider").alias("provider"), F.coalesce("b.title", "a.title").alias("title"), reason.alias("reason"), *cells)


def display_order() -> list[Column]:
    return [F.coalesce(*(F.when(F.col("category") == x, i) for i, x in enumerate(CHANGE_ORDER))), F.col("key")]


def in_display_order(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy(*display_order())


def by_category(deltas: DataFrame, category: str) -> DataFrame:
    return deltas.where(F.col("category") == category)


def counts_by_category(deltas: DataFrame) -> DataFrame:
    return counts_by(deltas, "category", CHANGES)
