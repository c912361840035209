"""Stages of the listing pipeline, from DataFrame to DataFrame."""

from .compare import counts_by_category, in_display_order
from .deduplicate import assign_groups, canonical, totals
from .normalize import Chain, default_chain
from .opportunity import analyze, score
from .pricing import attach_prices, comparables, market_prices
from .ranking import actionable, counts_by_recommendation, select_items, with_rank

__all__ = ["Chain", "actionable", "analyze", "assign_groups", "attach_prices", "canonical", "comparables", "counts_by_category", "counts_by_recommendation", "default_chain", "in_display_order", "market_prices", "score", "select_items", "totals", "with_rank"]
