"""Column functions: text, similarity, title rules, rounding."""

from .rounding import clamp, fixed, money, money_exact
from .similarity import brand_tokens, decision, explain, features, jaccard, model_tokens, overlap_coefficient, pair_score
from .terms import classify_title, compact_match, matching_terms, word_match
from .text import clean_text, condition_name, currency_code, fingerprint, identity_key, location_name, normalize_unicode, tokenize

__all__ = ["brand_tokens", "clamp", "classify_title", "clean_text", "compact_match", "condition_name", "currency_code", "decision", "explain", "features", "fingerprint", "fixed", "identity_key", "jaccard", "location_name", "matching_terms", "model_tokens", "money", "money_exact", "normalize_unicode", "overlap_coefficient", "pair_score", "tokenize", "word_match"]
