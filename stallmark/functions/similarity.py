"""Similarity of two token arrays, as expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig
from .rounding import clamp, fixed, money


def token_set(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Of two sets; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def model_tokens(tokens: Column) -> Column:
    """Tokens with a digit, and a letter or at least three characters."""
    return F.filter(tokens, lambda t: t.rlike("[0-9]") & (t.rlike("[a-z]") | (F.length(t) >= 3)))


def brand_tokens(tokens: Column, brands: tuple[str, ...]) -> Column:
    return F.array_intersect(tokens, F.array(*(F.lit(b) for b in brands)).cast("array<string>"))


def agreement(a: Column, b: Column) -> Column:
    """True if the sets meet, false if not, null if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def features(tokens: Column, config: MatchConfig) -> Column:
    """What a pair score needs of one side, computed once: its token, model and brand sets."""
    s = token_set(tokens)
    return F.struct(s.alias("tokens"), model_tokens(s).alias("models"), brand_tokens(s, config.brands).alias("brands"))


def pair_score(a: Column, b: Column, config: MatchConfig | None = None) -> Column:
    """The similarity in [0, 1] of two ``features``, rounded to 4 places."""
    c = config or MatchConfig()
    base = (1 - c.overlap_weight) * jaccard(a["tokens"], b["tokens"]) + c.overlap_weight * overlap_coefficient(a["tokens"], b["tokens"])
    models, brands = agreement(a["models"], b["models"]), agreement(a["brands"], b["brands"])
    s = F.when(models, base + (1 - base) * c.shared_model_boost).when(~models, F.least(base, F.lit(c.model_conflict_cap))).otherwise(base)
    s = F.when(brands, s + (1 - s) * c.shared_brand_boost).when(~brands, s * c.brand_conflict_factor).otherwise(s)
    return F.when((F.size(a["tokens"]) == 0) | (F.size(b["tokens"]) == 0), F.lit(0.0)).otherwise(money(clamp(s), 4))


def decision(score: Column, config: MatchConfig | None = None) -> Column:
    c = config or MatchConfig()
    return F.when(score >= c.same_threshold, "same_product").when(score >= c.possible_threshold, "possible_match").otherwise("different_product")


def explain(a: Column, b: Column, score: Column, config: MatchConfig | None = None) -> Column:
    """The reasons of a pair score, as an array of texts."""
    c = config or MatchConfig()
    j, o = jaccard(a["tokens"], b["tokens"]), overlap_coefficient(a["tokens"], b["tokens"])
    base = (1 - c.overlap_weight) * j + c.overlap_weight * o
    both = lambda name: F.array_join(F.array_sort(F.array_intersect(a[name], b[name])), ", ")
    each = lambda name: F.concat(*(x for side, sep in ((a, " vs "), (b, "")) for x in (F.lit("['"), F.array_join(F.array_sort(side[name]), "', '"), F.lit("']" + sep))))
    models, brands = agreement(a["models"], b["models"]), agreement(a["brands"], b["brands"])
    empty = (F.size(a["tokens"]) == 0) | (F.size(b["tokens"]) == 0)
    full = F.array_compact(
        F.array(
            F.concat(F.lit("token similarity "), fixed(base), F.lit(" (jaccard="), fixed(j), F.lit(", overlap="), fixed(o), F.lit("; "), F.size(F.array_intersect(a["tokens"], b["tokens"])).cast("string"), F.lit(" shared)")),
            F.when(models, F.concat(F.lit("shared model identifier(s): "), both("models"))).when(~models, F.concat(F.lit("conflicting model identifiers: "), each("models"))),
            F.when(brands, F.concat(F.lit("shared brand: "), both("brands"))).when(~brands, F.concat(F.lit("conflicting brands: "), each("brands"))),
            F.concat(F.lit("decision "), decision(score, c), F.lit(" at score "), fixed(score)),
        )
    )
    return F.when(empty, F.array(F.lit("one or both listings have no comparable tokens"))).otherwise(full)
