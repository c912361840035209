"""Rounding that two engines compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column, places: int = 2) -> Column:
    """Half up on the binary value, in plain arithmetic: the same in every engine (round() on doubles is not)."""
    p = float(10**places)
    return F.floor(x * p + 0.5) / F.lit(p)


def money_exact(x: Column, places: int = 2) -> Column:
    """Half to even on the exact binary value, as Python's round() gives it; not used by the stages, whose results SQL can compute too."""
    return fixed(x, places).cast("double")


def clamp(x: Column) -> Column:
    """x within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fixed(x: Column, places: int = 2, *, signed: bool = False) -> Column:
    """The number with so many places, rounded from its exact binary value as printf does (format_string rounds its shortest decimal half up)."""
    plain = "0." + "0" * places
    return F.call_function("format_number", x, F.lit(f"+{plain};-{plain}" if signed else plain))
