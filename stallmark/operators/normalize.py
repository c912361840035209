"""Normalization: an ordered, editable chain of projections, which Catalyst collapses into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FILLER_WORDS, NormalizationConfig
from ..functions import text as X

Step = Callable[[DataFrame], DataFrame]


class Chain:
    """Named steps in order. Editing gives a new chain; a missing name is a KeyError."""

    def __init__(self, steps: list[tuple[str, Step]] | None = None):
        if any(not name for name, _ in steps or []):
            raise ValueError("a step needs a name")
        self.steps = list(steps or [])

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.steps]

    def _place(self, name: str) -> int:
        if name not in self.names:
            raise KeyError(name)
        return self.names.index(name)

    def add(self, name: str, step: Step, *, before: str | None = None) -> Chain:
        at = len(self.steps) if before is None else self._place(before)
        return Chain([*self.steps[:at], (name, step), *self.steps[at:]])

    def remove(self, name: str) -> Chain:
        at = self._place(name)
        return Chain(self.steps[:at] + self.steps[at + 1 :])

    def __call__(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df


def seed(df: DataFrame) -> DataFrame:
    """Raw columns stay; the normalized ones start as their copies, prefixed ``n_``."""
    return df.withColumns({"n_title": F.col("title"), "tokens": F.array().cast("array<string>"), "n_currency": F.col("currency"), "n_condition": F.col("condition"), "n_location": F.col("location")})


def default_chain(config: NormalizationConfig | None = None) -> Chain:
    c = config or NormalizationConfig()

    def on_title(function: Callable) -> Step:
        return lambda df: df.withColumn("n_title", function(F.col("n_title")))

    def clean(t):
        t = X.normalize_punctuation(X.remove_control_characters(t))
        return X.remove_symbols(t) if c.remove_emoji else t

    def title(df: DataFrame) -> DataFrame:
        t = X.collapse_whitespace(F.col("n_title"))
        t = F.lower(t) if c.lowercase_title else t
        words = (FILLER_WORDS if c.filler_words is None else c.filler_words) if c.remove_filler_words else ()
        return df.withColumn("n_title", t).withColumn("tokens", X.without_words(X.tokenize(F.col("n_title")), words))

    return Chain(
        [
            ("unicode", on_title(lambda t: X.normalize_unicode(t, c.unicode_form))),
            ("text_cleaning", on_title(clean)),
            ("whitespace", on_title(X.collapse_whitespace)),
            ("title_cleanup", title),
            ("currency", lambda df: df.withColumn("n_currency", X.currency_code(F.col("n_currency"), default=c.default_currency, aliases=c.currency_aliases))),
            ("condition", lambda df: df.withColumn("n_condition", X.condition_name(F.col("n_condition"), aliases=c.condition_aliases))),
            ("location", lambda df: df.withColumn("n_location", X.location_name(F.col("n_location"), aliases=c.location_aliases))),
        ]
    )


def normalize(df: DataFrame, config: NormalizationConfig | None = None, chain: Chain | None = None) -> DataFrame:
    """Listings with n_title, tokens, n_currency, n_condition and n_location."""
    return (chain or default_chain(config))(seed(df))
