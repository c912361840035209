"""Title rules: terms found in a title, and the decision table of its class."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ClassificationConfig
from .text import tokenize


def term_tokens(term: str) -> list[str]:
    return re.findall("[a-z0-9]+", term.lower())


def word_match(term: str, tokens: Column) -> Column:
    """Do the term's tokens stand in a row among the tokens? Never for a term without any."""
    needle = term_tokens(term)
    if not needle:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(needle)} "))


def compact_match(term: str, tokens: Column) -> Column:
    """Is the term, without signs and spaces, a part of the tokens joined together?"""
    needle = "".join(term_tokens(term))
    return F.contains(F.array_join(tokens, ""), F.lit(needle)) if needle else F.lit(False)


def matching_terms(terms: tuple[str, ...], tokens: Column) -> Column:
    """All terms that match, each once, in their own order."""
    found = [F.when(word_match(t, tokens), F.lit(t)) for t in dict.fromkeys(terms)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def required_tokens(query: str, config: ClassificationConfig) -> list[str]:
    """The tokens that a title has to have: of the required terms, or of the query."""
    return [t for term in (config.required_terms if config.required_terms is not None else term_tokens(query)) for t in term_tokens(term)]


def classify_title(title: Column, query: str, config: ClassificationConfig | None = None) -> Column:
    """A struct (classification, match_confidence, reason); the first rule that fits decides."""
    c = config or ClassificationConfig()
    tokens = tokenize(title)
    need = required_tokens(query, c)
    excluded = F.get(matching_terms(c.excluded_terms, tokens), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(~compact_match(t, tokens), F.lit(t)) for t in need))) if need else F.array().cast("array<string>")
    accessories, parts = matching_terms(c.accessory_terms, tokens), matching_terms(c.part_terms, tokens)

    def verdict(name: str, confidence: Column | int, reason: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(name).alias("classification"), lit(confidence).alias("match_confidence"), lit(reason).alias("reason"))

    def listed(kind: str, found: Column) -> Column:
        return F.concat(F.lit(f"{kind} keyword"), F.when(F.size(found) > 1, "s").otherwise(""), F.lit(": "), F.array_join(found, ", "))

    rule = F.when(excluded.isNotNull(), verdict("rejected", 95, F.concat(F.lit("Excluded keyword: "), excluded)))
    if need:
        rule = rule.when(F.size(missing) == len(need), verdict("rejected", 90, f"Missing required term: {' '.join(need)}"))
        rule = rule.when(F.size(missing) > 0, verdict("unknown", 45, F.concat(F.lit("Partial match; missing required term: "), F.array_join(missing, " "))))
    rule = rule.when(F.size(accessories) > 0, verdict("accessory", F.when(F.size(accessories) == 1, 90).otherwise(92), listed("Accessory", accessories)))
    rule = rule.when(F.size(parts) > 0, verdict("part", 90, listed("Part", parts)))
    if not need:
        return rule.otherwise(verdict("complete_product", 60, "No required terms defined"))
    strong = compact_match(" ".join(need), tokens)
    return rule.otherwise(verdict("complete_product", F.when(strong, 95).otherwise(80), F.when(strong, "Strong model match").otherwise("All required terms present")))
