"""Order, filters and counts of opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RECOMMENDATIONS
from ..shared import numbered
from .opportunity import recommendation_rank

SORTS = {"score": "recommendation_score", "roi": "roi_percentage", "net_profit": "net_profit", "confidence": "confidence_score"}


def order(sort: str = "recommendation") -> list[Column]:
    """Sort keys; missing figures come last and the listing id decides ties."""
    if sort == "recommendation":
        return [recommendation_rank(F.col("recommendation")).desc(), F.col("roi_percentage").desc_nulls_last(), F.col("confidence_score").desc(), F.col("listing_id").asc()]
    return [F.col(SORTS[sort]).desc_nulls_last(), F.col("listing_id").asc()]


def with_rank(df: DataFrame, partition: str = "query") -> DataFrame:
    """df with ``rank``, from 1 on inside each query."""
    return numbered(df, partition, order(), "rank")


def actionable(df: DataFrame) -> DataFrame:
    return df.where(F.col("recommendation").isin("buy", "strong_buy"))


def select_items(df: DataFrame, *, actionable_only: bool = False, min_recommendation: str | None = None, min_roi: float | None = None, min_net_profit: float | None = None) -> DataFrame:
    """The rows that pass all filters given; rows without the figure asked for do not."""
    if actionable_only:
        df = actionable(df)
    if min_recommendation is not None:
        df = df.where(recommendation_rank(F.col("recommendation")) >= recommendation_rank(F.lit(min_recommendation)))
    if min_roi is not None:
        df = df.where(F.col("roi_percentage") >= min_roi)
    if min_net_profit is not None:
        df = df.where(F.col("net_profit") >= min_net_profit)
    return df


def counts_by(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n): a row for each of the values, also those that do not occur."""
    counted = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values)))
    return df.agg(*counted).select(pairs.alias("x")).select("x.*")


def counts_by_recommendation(df: DataFrame) -> DataFrame:
    return counts_by(df, "recommendation", RECOMMENDATIONS)
