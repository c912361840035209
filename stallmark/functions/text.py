"""Text functions over columns. Null stays null except where said."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONDITION_ALIASES, CURRENCY_ALIASES, LOCATION_ALIASES
from ..schemas import CONDITIONS

# Typographic characters and their plain forms, in natural order.
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", "…": "...",
}


def normalize_unicode(text: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form. ASCII texts never leave the JVM; the others go through one Arrow UDF."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(normal(F.when(~plain, text)))


def remove_control_characters(text: Column) -> Column:
    """Without control and format characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")


def normalize_punctuation(text: Column) -> Column:
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for k, v in PUNCTUATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def remove_symbols(text: Column) -> Column:
    """Without emoji and other symbols; currency and mathematical signs stay."""
    return F.regexp_replace(text, r"[\p{So}\p{Sk}\p{Cs}]", "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def clean_text(text: Column, form: str = "NFKC") -> Column:
    return collapse_whitespace(normalize_punctuation(remove_control_characters(normalize_unicode(text, form))))


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, repeats kept. Null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def without_words(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def look_up(aliases: Mapping[str, str], key: Column) -> Column:
    """The value of an alias, null for others."""
    if not aliases:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), key)


def currency_code(value: Column, *, default: str | None = None, aliases: Mapping[str, str] | None = None) -> Column:
    """An ISO code: null or blank gives the default, an alias its code, three unknown letters themselves in capitals, else null."""
    key = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    known = {k.lower(): v for k, v in (aliases or CURRENCY_ALIASES).items()}
    rest = F.coalesce(look_up(known, key), F.when(key.rlike(r"^\p{L}{3}$"), F.upper(key)))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(default.upper() if default else None).cast("string")).otherwise(rest)


def condition_name(value: Column, *, aliases: Mapping[str, str] | None = None) -> Column:
    """A condition; one of the enumeration stays, an alias is looked up, anything else is unknown."""
    known = {k.lower(): v for k, v in (aliases or CONDITION_ALIASES).items()}
    return F.when(value.isin(*CONDITIONS), value).otherwise(F.coalesce(look_up(known, F.lower(collapse_whitespace(value))), F.lit("unknown")))


def title_case(text: Column) -> Column:
    """Each run of letters with one capital in front, whatever stands before it (as in O'Brien)."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2), F.length(w))))), "")


def location_name(value: Column, *, aliases: Mapping[str, str] | None = None) -> Column:
    """A tidy place: an alias's name, else the cleaned text in title case; null or blank gives null."""
    cleaned = F.nullif(clean_text(value), F.lit(""))
    known = {k.lower(): v for k, v in (aliases or LOCATION_ALIASES).items()}
    return F.coalesce(look_up(known, F.regexp_replace(F.lower(cleaned), r"\.+$", "")), title_case(cleaned))


def identity_key(provider: Column, title: Column) -> Column:
    return F.concat_ws("|", F.lower(F.regexp_replace(provider, r"(?U)^\s+|\s+$", "")), F.lower(collapse_whitespace(title)))


def fingerprint(tokens: Column, currency: Column, condition: Column) -> Column:
    """16 hex digits of the SHA-256 of a listing's distinct tokens, currency and condition."""
    text = F.concat(F.lit("tokens="), F.array_join(F.array_sort(F.array_distinct(tokens)), " "), F.lit("|currency="), F.coalesce(currency, F.lit("")), F.lit("|condition="), condition)
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def plain_number(x: Column) -> Column:
    """A number as text, without .0 for whole ones."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
