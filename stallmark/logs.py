"""Logging under one name, with fields as key=value."""

from __future__ import annotations

import logging

ROOT = "stallmark"
_FORM = "%(asctime)s %(levelname)-8s %(name)s: %(message)s"


class _PackageHandler(logging.StreamHandler):
    """The one handler that ``configure`` attaches; its class tells that it is there."""


def logger(*names: str) -> logging.Logger:
    """The package's logger, or the one with these names below it."""
    return logging.getLogger(".".join((ROOT, *names)))


def configure(level: int | str = logging.INFO) -> logging.Logger:
    """Show the package's messages from this level on. Calling it again changes the level only; other loggers stay as they are."""
    out = logger()
    if not any(isinstance(h, _PackageHandler) for h in out.handlers):
        shown = _PackageHandler()
        shown.setFormatter(logging.Formatter(_FORM))
        out.addHandler(shown)
        out.propagate = False
    out.setLevel(level)
    return out


def fields(**values: object) -> str:
    """The values that are not None as ``key=value`` in their order; those with spaces in quotation marks."""
    shown = {k: str(v) for k, v in values.items() if v is not None}
    return " ".join(f'{k}="{v}"' if " " in v else f"{k}={v}" for k, v in shown.items())
