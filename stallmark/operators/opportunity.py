"""Costs, profit, recommendation, risk and score, as expressions over a priced group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OpportunityConfig, ScoringConfig
from ..functions.rounding import clamp, fixed, money
from ..schemas import RECOMMENDATIONS


def costs(sale: Column, gross: Column, config: OpportunityConfig) -> Column:
    """A struct of the six costs, each rounded, and their total."""
    c = config
    parts = {
        "marketplace_fee": money(sale * c.marketplace_fee_rate),
        "payment_fee": money(sale * c.payment_fee_rate + c.payment_fee_flat),
        "shipping_cost": money(F.lit(c.shipping_cost)),
        "packaging_cost": money(F.lit(c.packaging_cost)),
        "buffer": money(sale * c.buffer_rate + c.buffer_flat),
        "tax": money(F.greatest(F.lit(0.0), gross) * c.tax_rate),
    }
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    return F.struct(*(v.alias(k) for k, v in parts.items()), money(total).alias("total"))


def analyze(df: DataFrame, config: OpportunityConfig | None = None, *, price: str = "price", currency: str = "currency", market: str = "market") -> DataFrame:
    """df and recommendation, confidence_score, currency mismatch guards, profit columns and reasons.

    Guards in order: no asking price, no market price, another currency (the raw
    one of the listing). A guarded row is rejected with null profit columns.
    """
    c = config or OpportunityConfig()
    m = lambda name: F.col(f"{market}.{name}")
    ask, sale = F.col(price), m("estimated_market_price")
    other = m("currency").isNotNull() & ~F.col(currency).eqNullSafe(m("currency")) if c.require_same_currency else F.lit(False)
    guard = (
        F.when(ask.isNull(), F.lit("listing has no asking price"))
        .when(sale.isNull(), F.lit("no market price estimate available"))
        .when(other, F.concat(F.lit("currency mismatch: asking "), F.coalesce(F.col(currency), F.lit("None")), F.lit(" vs market "), m("currency")))
    )
    out = df.withColumn("guard", guard).withColumn("confidence_score", m("confidence_score"))
    free = F.col("guard").isNull()
    out = out.withColumn("asking_price", F.when(free, money(ask))).withColumn("estimated_market_price", F.when(free, money(sale)))
    ask, sale = F.col("asking_price"), F.col("estimated_market_price")
    out = out.withColumn("costs", F.when(free, costs(sale, sale - ask, c)))
    out = out.withColumn("gross_profit", money(sale - ask)).withColumn("net_profit", money(sale - ask - F.col("costs.total")))
    net = F.col("net_profit")
    out = out.withColumn("roi_percentage", F.when(ask <= 0, 0.0).otherwise(money(F.try_divide(net, ask) * 100)))
    out = out.withColumn("margin_percentage", F.when(sale <= 0, 0.0).otherwise(money(F.try_divide(net, sale) * 100)))
    roi, sure = F.col("roi_percentage") / 100, F.col("confidence_score")
    tier = F.when(roi >= c.strong_buy_roi, "strong_buy").when(roi >= c.buy_roi, "buy").when(roi >= c.watch_roi, "watch")
    second = F.when((tier == "strong_buy") & (sure < c.strong_buy_confidence), "buy").otherwise(tier)
    third = F.when(second.isin("strong_buy", "buy") & (sure < c.min_confidence), "watch").otherwise(second)
    floored = net <= c.min_net_profit
    out = out.withColumn("recommendation", F.when(~free | floored, "reject").otherwise(F.coalesce(third, F.lit("reject"))))
    percent = lambda x: F.concat(fixed(x, 1), F.lit("%"))
    tiered = ~floored & tier.isNotNull()
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("net profit "), fixed(net), F.lit(" ("), percent(F.col("roi_percentage")), F.lit(" ROI, "), percent(F.col("margin_percentage")), F.lit(" margin); costs "), fixed(F.col("costs.total"))),
            F.when(floored, F.lit(f"net profit <= floor {c.min_net_profit:.2f} -> REJECT")),
            F.when(~floored & tier.isNull(), F.concat(F.lit("ROI "), percent(F.col("roi_percentage")), F.lit(" below watch threshold -> REJECT"))),
            F.when(tiered & (tier != second), F.concat(F.lit("confidence "), fixed(sure), F.lit(f" < {c.strong_buy_confidence:.2f} -> capped at BUY"))),
            F.when(tiered & (second != third), F.concat(F.lit("confidence "), fixed(sure), F.lit(f" < {c.min_confidence:.2f} -> capped at WATCH"))),
            F.when(tiered, F.concat(F.lit("ROI "), percent(F.col("roi_percentage")), F.lit(" -> "), third)),
        )
    )
    return out.withColumn("reasons", F.when(free, reasons).otherwise(F.array("guard"))).drop("guard")


def risk(market: Column, config: ScoringConfig | None = None) -> Column:
    """The mean of dispersion and missing coverage, in [0, 1]; 1 without a price or median."""
    c = config or ScoringConfig()
    median = market["median_price"]
    spread = F.when(median > 0, clamp(F.try_divide(market["max_price"] - market["min_price"], median) / c.risk_dispersion_reference)).otherwise(1.0)
    coverage = clamp((F.lit(c.risk_full_comparables) - market["comparable_count"]) / c.risk_full_comparables)
    return F.when(market["estimated_market_price"].isNull() | (F.coalesce(median, F.lit(0.0)) == 0), 1.0).otherwise(clamp((spread + coverage) / 2))


def score_signals(roi: Column, profit: Column, confidence: Column, risk_: Column, config: ScoringConfig | None = None) -> Column:
    """A struct (score 0 to 100, the four signals)."""
    c = config or ScoringConfig()
    r, p, s, k = (clamp(x) for x in (roi, profit, confidence, risk_))
    weighted = c.roi_weight * r + c.net_profit_weight * p + c.confidence_weight * s - c.risk_weight * k
    score = money(clamp((weighted + c.risk_weight) / c.total_weight) * 100)
    return F.struct(score.alias("score"), *(money(x, 4).alias(n) for n, x in (("roi_signal", r), ("profit_signal", p), ("confidence_signal", s), ("risk_signal", k))))


def score(df: DataFrame, config: ScoringConfig | None = None, *, market: str | None = "market") -> DataFrame:
    """df and recommendation_score, risk_score and the struct ``signals``. Without market prices the risk is 1 - confidence."""
    c = config or ScoringConfig()
    sure = clamp(F.col("confidence_score"))
    signal = lambda name, reference: F.coalesce(clamp(F.col(name) / reference), F.lit(0.0))
    threat = risk(F.col(market), c) if market else clamp(1 - sure)
    out = df.withColumn("signals", score_signals(signal("roi_percentage", c.roi_reference), signal("net_profit", c.net_profit_reference), sure, threat, c))
    return out.withColumn("recommendation_score", F.col("signals.score")).withColumn("risk_score", F.col("signals.risk_signal"))


def recommendation_rank(column: Column) -> Column:
    return F.coalesce(*(F.when(column == r, len(RECOMMENDATIONS) - 1 - i) for i, r in enumerate(RECOMMENDATIONS)))
