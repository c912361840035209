"""Synthetic and live sources of listings, and their union."""

from .live import Capabilities, CatalogSource, Credentials, LiveConfig, SearchSource, live_source
from .marketplace_json import catalog_listings, market_summary, search_listings
from .scan import Source, configured_sources, default_sources, register_source, search, source_named
from .synthetic import SyntheticSource

__all__ = ["Capabilities", "CatalogSource", "Credentials", "LiveConfig", "SearchSource", "Source", "SyntheticSource", "catalog_listings", "configured_sources", "default_sources", "live_source", "market_summary", "register_source", "search", "search_listings", "source_named"]
