"""Schemas and enumerations of the listing pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations, in their natural order.
CONDITIONS = ("new", "used", "refurbished", "unknown")
CLASSIFICATIONS = ("complete_product", "accessory", "part", "unknown", "rejected")
DECISIONS = ("same_product", "possible_match", "different_product")
RECOMMENDATIONS = ("strong_buy", "buy", "watch", "reject")
CHANGES = ("new", "disappeared", "unchanged", "improved", "worsened")
#: The order in which changes are shown.
CHANGE_ORDER = ("new", "improved", "worsened", "unchanged", "disappeared")

LISTING = T.StructType(
    [
        T.StructField("listing_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("condition", T.StringType(), False),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("scanned_at", T.TimestampType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

RUN = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("config_summary", T.StringType(), False),
        T.StructField("total_listings_scanned", T.LongType(), False),
        T.StructField("total_groups", T.LongType(), False),
        T.StructField("total_opportunities", T.LongType(), False),
    ]
)

OPPORTUNITY = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("rank", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("currency", T.StringType()),
        T.StructField("asking_price", T.DoubleType()),
        T.StructField("estimated_market_price", T.DoubleType()),
        T.StructField("roi_percentage", T.DoubleType()),
        T.StructField("net_profit", T.DoubleType()),
        T.StructField("confidence_score", T.DoubleType(), False),
        T.StructField("risk_score", T.DoubleType(), False),
        T.StructField("recommendation_score", T.DoubleType(), False),
        T.StructField("recommendation", T.StringType(), False),
    ]
)
