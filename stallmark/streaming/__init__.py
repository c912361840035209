"""The pipeline over a stream of new listings."""

from .incremental import follow

__all__ = ["follow"]
