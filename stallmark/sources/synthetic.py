"""Synthetic listings: row i of a source and query follows from a hash of (source, query, i) alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SyntheticSource:
    name: str
    base_url: str
    locations: tuple[str, ...]
    currency: str = "EUR"

    def fetch(self, spark: SparkSession, query: str, limit: int) -> DataFrame:
        """The first ``limit`` listings, made where they are needed."""
        i = F.col("id")
        digits = F.substring(F.sha2(F.concat_ws("|", F.lit(self.name), F.lit(query), i.cast("string")).cast("binary"), 256), 1, 8)
        seed = F.conv(digits, 16, 10).cast("bigint")
        pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (seed % len(values) + 1).cast("int"))
        return spark.range(limit).select(
            F.concat(F.lit(f"{self.name}-"), digits).alias("listing_id"),
            F.concat(F.lit(f"{query.title()} - {self.name} listing #"), (i + 1).cast("string")).alias("title"),
            F.lit(self.name).alias("provider"),
            F.concat(F.lit(f"{self.base_url}/item/"), digits).alias("url"),
            F.round(F.lit(50.0) + (seed % 195000) / 100.0, 2).alias("price"),
            F.lit(self.currency).alias("currency"),
            pick(self.locations).alias("location"),
            pick(("new", "used", "refurbished")).alias("condition"),
            F.lit(None).cast("timestamp").alias("posted_at"),
            F.current_timestamp().alias("scanned_at"),
            F.create_map(F.lit("mock"), F.lit("true"), F.lit("rank"), i.cast("string")).alias("extra"),
        )


# Names, addresses and places of the four built-in sources.
BUILT_IN = (
    SyntheticSource("ebay", "https://www.ebay.ie", ("Dublin", "Cork", "Galway", "International")),
    SyntheticSource("facebook_marketplace", "https://www.facebook.com/marketplace", ("Dublin", "Limerick", "Waterford", "Belfast")),
    SyntheticSource("adverts_ie", "https://www.adverts.ie", ("Dublin", "Cork", "Kildare", "Meath")),
    SyntheticSource("donedeal", "https://www.donedeal.ie", ("Dublin", "Cork", "Galway", "Donegal")),
)
