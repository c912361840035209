"""The pipeline and the history of its runs."""

from .history import History
from .pipeline import Pipeline, Result, analyze_listings

__all__ = ["History", "Pipeline", "Result", "analyze_listings"]
