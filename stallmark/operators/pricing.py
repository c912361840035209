"""Market prices: one currency for each group, outliers removed, robust statistics.

Rows are first added up by price, before the shuffle; all further steps are
windows and aggregates over the same keys, which share one more exchange. A group with
more than ``LARGE`` prices is not brought together: its prices are sorted in ranges, running
counts go from range to range by their sums, and quartiles, medians and trims are the
prices at the places so known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PairStrategy, PricingConfig
from ..functions.rounding import money
from ..shared import cut, cut_counted
from . import pair_strategies

#: A group with more distinct prices is ranked in ranges, by many tasks.
LARGE = 100_000
#: A list of at most so many large groups goes to all tasks.
_LISTED = 10_000


def comparables(listings: DataFrame) -> DataFrame:
    """Priced listings with their currency (the normalized one, else the raw) and a weight of 1."""
    currency = F.coalesce(F.nullif(F.col("n_currency"), F.lit("")), F.col("currency"))
    return listings.where("price is not null").withColumn("currency", currency).withColumn("weight", F.lit(1.0))


def by_price(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, currency, price, c, weight): one row for each price of a group, with its count and total weight.

    All statistics follow from these; rows are added up before they are
    shuffled, so that a group with a large share of all rows is no larger than its number of prices.
    """
    return df.where("price is not null").groupBy(*keys, "currency", "price").agg(F.count("*").alias("c"), exact_sum(F.col("weight")).alias("weight"))


def dominant_currency(df: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """(keys, currency): the most frequent currency of each group, of equally frequent ones the first by name."""
    counts = df.groupBy(*keys, "currency").agg(F.sum(F.lit(1) if count is None else count).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("currency", F.struct(-F.col("n"), "currency")).alias("currency"))


def select_currency(df: DataFrame, keys: list[str], currency: str | None = None, count: Column | None = None) -> DataFrame:
    """df in one currency for each group: the given one, else the dominant one."""
    if currency is not None:
        return df.where(F.col("currency") == currency)
    often = F.sum(F.lit(1) if count is None else count).over(Window.partitionBy(*keys, "currency"))
    first = F.min(F.struct(-F.col("_often"), "currency")).over(Window.partitionBy(*keys))
    return df.withColumn("_often", often).withColumn("_first", first).where("currency = _first.currency").drop("_often", "_first")


def quartiles(df: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """(keys, n, q1, q3), exact, with linear interpolation between the values."""
    count = F.lit(1) if count is None else count
    out = df.groupBy(*keys).agg(F.sum(count).cast("long").alias("n"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.75)), count).alias("q"))
    return out.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def strip_outliers(df: DataFrame, keys: list[str], config: PricingConfig | None = None, count: Column | None = None) -> DataFrame:
    """df without prices outside the fences of groups of four or more; adds ``n``, the size before."""
    c = config or PricingConfig()
    count, group = F.lit(1) if count is None else count, Window.partitionBy(*keys)
    sized = df.withColumn("n", F.sum(count).over(group))
    if not c.remove_outliers:
        return sized
    fenced = sized.withColumn("_q", F.percentile("price", F.array(F.lit(0.25), F.lit(0.75)), count).over(group))
    low, high = F.col("_q")[0], F.col("_q")[1]
    inside = F.col("price").between(low - c.iqr_multiplier * (high - low), high + c.iqr_multiplier * (high - low))
    return fenced.where(inside | (F.col("n") < 4)).drop("_q")


def exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of the rows: of decimals with six places."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def strategy_column(config: PricingConfig) -> Column:
    """The aggregate of a named strategy over ``by_price`` rows; a trimmed mean needs ``upto`` and ``kept``, the running and the whole count."""
    price, c, weight = F.col("price"), F.col("c"), F.col("weight")
    mean = F.try_divide(exact_sum(price * c), F.sum(c))
    if config.strategy == "median":
        return F.percentile(price, F.lit(0.5), c)
    if config.strategy == "weighted_average":
        return F.when(exact_sum(weight) <= 0, mean).otherwise(F.try_divide(exact_sum(price * weight), exact_sum(weight)))
    k = F.floor(F.col("kept") * config.trim_fraction)
    inside = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("kept") - k) - F.greatest(F.col("upto") - c, k))
    return F.try_divide(exact_sum(price * inside), F.sum(inside))


def percentile_by_place(p: float) -> Column:
    """What ``F.percentile`` gives for price, as an aggregate that holds two prices, over rows that know ``upto`` and ``kept``, the running and the whole count."""
    place = (F.col("kept") - 1) * F.lit(p)
    at = lambda i: F.max(F.when((F.col("upto") - F.col("c") <= i) & (i < F.col("upto")), F.col("price")))
    low, high, whole = at(F.floor(place)), at(F.ceil(place)), F.max(place)
    return F.when(low == high, low).otherwise((F.ceil(whole) - whole) * low + (whole - F.floor(whole)) * high)


def in_ranges(priced: DataFrame, keys: list[str]) -> DataFrame:
    """``by_price`` rows in ranges of (keys, currency, price), with ``_group`` (keys and currency) and the number of the range; no range has more than a task's share of a group."""
    ranged = priced.repartitionByRange(*keys, "currency", "price").withColumn("_range", F.spark_partition_id())
    return cut(ranged.withColumn("_group", F.struct(F.struct(*keys).alias("keys"), "currency")))


def kept_in_ranges(priced: DataFrame, keys: list[str], config: PricingConfig) -> DataFrame:
    """The rows of the chosen currency inside the fences, with ``n``, ``upto`` and ``kept``, for groups of any size.

    What is known of a group meets its rows by (group, range), so that no join or window has all of its rows.
    """
    c, group = config, Window.partitionBy("_group")
    ranged = in_ranges(priced, keys)
    sizes = ranged.groupBy("_group", "_range").agg(F.sum("c").alias("_n")).withColumns({"_keys": F.col("_group.keys"), "currency": F.col("_group.currency")})
    chosen = select_currency(sizes, ["_keys"], c.currency, F.col("_n"))
    before = F.sum("_n").over(group.orderBy("_range")) - F.col("_n")
    chosen = cut(chosen.select("_group", "_range", before.alias("_before"), F.sum("_n").over(group).alias("n")))
    running = F.col("_before") + F.sum("c").over(Window.partitionBy("_group", "_range").orderBy("price"))
    inside = cut(ranged.join(chosen, ["_group", "_range"]).withColumn("upto", running).drop("_before"))
    if c.remove_outliers:
        fences = inside.withColumn("kept", F.col("n")).groupBy("_group").agg(percentile_by_place(0.25).alias("q1"), percentile_by_place(0.75).alias("q3"))
        fences = chosen.select("_group", "_range").join(fences, "_group")
        margin = c.iqr_multiplier * (F.col("q3") - F.col("q1"))
        between = F.col("price").between(F.col("q1") - margin, F.col("q3") + margin)
        inside = inside.join(fences, ["_group", "_range"]).where(between | (F.col("n") < 4)).drop("q1", "q3")
    left = inside.groupBy("_group", "_range").agg(F.min(F.col("upto") - F.col("c")).alias("_first"), F.sum("c").alias("_n"))
    left = left.select("_group", "_range", F.min("_first").over(group).alias("_below"), F.sum("_n").over(group).alias("kept"))
    return inside.join(left, ["_group", "_range"]).withColumn("upto", F.col("upto") - F.col("_below")).drop("_below", "_group", "_range")


def kept_together(priced: DataFrame, keys: list[str], config: PricingConfig) -> DataFrame:
    """As ``kept_in_ranges`` for groups that fit a task; ``upto`` and ``kept`` only for a trimmed mean."""
    count = F.col("c")
    priced = priced.repartition(*keys)  # serves all windows and the aggregate of the statistics
    kept = strip_outliers(select_currency(priced, keys, config.currency, count), keys, config, count)
    if config.strategy == "trimmed_mean":
        group = Window.partitionBy(*keys)
        kept = kept.withColumn("upto", F.sum("c").over(group.orderBy("price"))).withColumn("kept", F.sum("c").over(group))
    return kept


def _statistics(kept: DataFrame, keys: list[str], config: PricingConfig, ranked: bool) -> DataFrame:
    """A row for each group of kept rows; ``ranked`` ones know their places."""
    price, count = F.col("price"), F.col("c")
    median = percentile_by_place(0.5) if ranked else F.percentile(price, F.lit(0.5), count)
    estimate = F.lit(None).cast("double") if not isinstance(config.strategy, str) else median if config.strategy == "median" else strategy_column(config)
    return kept.groupBy(*keys).agg(
        F.first("currency").alias("currency"),
        estimate.alias("e"),
        F.min(price).alias("lo"),
        F.max(price).alias("hi"),
        median.alias("md"),
        F.try_divide(exact_sum(price * count), F.sum("c")).alias("mean"),
        F.sum("c").alias("comparable_count"),
        F.first("n").alias("n"),
    )


def market_prices(df: DataFrame, keys: list[str], config: PricingConfig | None = None, *, large: int = LARGE) -> DataFrame:
    """A row for each group with a price of the chosen currency.

    Columns: keys, currency, estimated_market_price, min_price, max_price,
    median_price, mean_price, comparable_count, outliers_removed,
    confidence_score, reliable, strategy. ``df`` has keys, price, currency, weight.
    A group with more than ``large`` distinct prices is ranked by many tasks; its figures are the same.
    """
    c = config or PricingConfig()
    priced = cut(by_price(df, keys).withColumn("_keys", F.struct(*keys)))
    crowded, n_crowded = cut_counted(priced.groupBy("_keys").agg(F.count("*").alias("m")).where(F.col("m") > large).select("_keys"))
    rest = priced
    if n_crowded:
        listed = F.broadcast(crowded) if n_crowded <= _LISTED else crowded
        rest = priced.join(listed, "_keys", "left_anti")
    kept = kept_together(rest.drop("_keys"), keys, c)
    stats = _statistics(kept, keys, c, ranked=False)
    if n_crowded:
        ranked = kept_in_ranges(priced.join(listed, "_keys", "left_semi").drop("_keys"), keys, c)
        stats = stats.unionByName(_statistics(ranked, keys, c, ranked=True))
        kept = kept.unionByName(ranked, allowMissingColumns=True)
    if not isinstance(c.strategy, str):
        keyed = lambda x: x.withColumn("_keys", F.struct(*keys))  # noqa: E731  (a null key is a group too)
        if isinstance(c.strategy, PairStrategy):
            found = pair_strategies.estimates(kept, keys, c.strategy)
        else:  # an aggregate of one's own sees the listings themselves
            rows = keyed(df).join(keyed(kept).select("_keys", "currency", "price"), ["_keys", "currency", "price"], "left_semi")
            found = rows.groupBy(*keys).agg(c.strategy(F.col("price"), F.col("weight")).alias("e"))
        stats = keyed(stats.drop("e")).join(keyed(found).select("_keys", "e"), "_keys").drop("_keys")
    spread = F.when((F.col("comparable_count") > 1) & (F.col("mean") > 0), 1 / (1 + F.try_divide(F.col("hi") - F.col("lo"), F.col("mean")))).otherwise(1.0)
    confidence = money(F.least(F.lit(1.0), F.col("comparable_count") / c.confidence_full_count) * spread, 4)
    shown = {"estimated_market_price": "e", "min_price": "lo", "max_price": "hi", "median_price": "md", "mean_price": "mean"}
    return stats.select(
        *keys,
        "currency",
        *(money(F.col(v)).alias(k) for k, v in shown.items()),
        "comparable_count",
        (F.col("n") - F.col("comparable_count")).alias("outliers_removed"),
        confidence.alias("confidence_score"),
        (F.col("comparable_count") >= c.min_comparables).alias("reliable"),
        F.lit(c.strategy_name).alias("strategy"),
    )


def attach_prices(groups: DataFrame, prices: DataFrame, keys: list[str], config: PricingConfig | None = None) -> DataFrame:
    """Every group with its price in the struct ``market``; a group without one has nulls, no comparables and no confidence."""
    c = config or PricingConfig()
    cells = [x for x in prices.columns if x not in keys]
    empty = {"comparable_count": 0, "outliers_removed": 0, "confidence_score": 0.0, "reliable": False}
    packed = prices.select(*keys, F.struct(*cells).alias("p"), F.lit(True).alias("found"))
    out = groups.join(packed, keys, "left")
    name = F.lit(c.strategy_name)
    fields = []
    for x in cells:
        value = F.col(f"p.{x}")
        if x in empty:
            value = F.coalesce(value, F.lit(empty[x]))
        elif x == "strategy":
            value = name
        elif x == "currency":
            value = F.coalesce(value, F.lit(c.currency).cast("string"))
        fields.append(value.alias(x))
    return out.withColumn("market", F.struct(*fields)).drop("p", "found")
