"""One frozen dataclass for each stage, and a strict TOML loader."""

from __future__ import annotations

import tomllib
import types
import typing
from collections.abc import Callable, Mapping
from dataclasses import MISSING, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column

# Fixed values, in their natural order.
DEFAULT_PROVIDERS = ("ebay", "facebook_marketplace", "adverts_ie", "donedeal")
UNICODE_FORMS = ("NFC", "NFD", "NFKC", "NFKD")
STRATEGIES = ("median", "trimmed_mean", "weighted_average")
FILLER_WORDS = ("the", "a", "an", "for", "with", "and", "brand", "new", "genuine", "official")
BRANDS = (
    "nvidia", "amd", "intel", "apple", "samsung", "sony", "lg", "asus", "msi", "gigabyte", "evga", "zotac", "dell",
    "hp", "lenovo", "acer", "razer", "microsoft", "google", "huawei", "xiaomi", "oneplus", "nintendo", "logitech", "corsair",
)
ACCESSORY_TERMS = (
    "cable", "cables", "power cable", "power lead", "power cord", "adapter", "adaptor", "connector", "extension", "riser",
    "riser cable", "bracket", "mount", "stand", "holder", "sleeve", "bag", "cover", "dust cover", "skin", "waterblock",
    "water block", "anti sag", "support bracket",
)
PART_TERMS = (
    "fan", "fans", "replacement", "replacement fan", "spare", "spares", "spare part", "spare parts", "for parts",
    "spares or repair", "faulty", "not working", "repair", "pcb", "heatsink", "heat sink", "cooler", "shroud", "backplate",
    "thermal pad", "thermal pads", "capacitor", "vram",
)
EXCLUDED_TERMS = (
    "empty box", "box only", "just the box", "poster", "sticker", "stickers", "keyring", "keychain", "mug", "t shirt",
    "tshirt", "case badge", "figurine", "mouse mat", "mousemat", "mouse pad", "coaster",
)
CURRENCY_ALIASES = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "stg": "GBP",
}
CONDITION_ALIASES = {
    "new": "new", "brand new": "new", "bnib": "new", "new with tags": "new", "new with box": "new", "sealed": "new",
    "used": "used", "pre-owned": "used", "preowned": "used", "second hand": "used", "secondhand": "used", "open box": "used",
    "refurbished": "refurbished", "refurb": "refurbished", "renewed": "refurbished", "reconditioned": "refurbished",
}
LOCATION_ALIASES = {
    "co dublin": "Dublin", "co. dublin": "Dublin", "county dublin": "Dublin", "dublin city": "Dublin", "baile atha cliath": "Dublin",
    "co cork": "Cork", "co. cork": "Cork", "county cork": "Cork", "co galway": "Galway", "co. galway": "Galway",
    "intl": "International", "international": "International",
}


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ScannerConfig:
    providers: tuple[str, ...] = DEFAULT_PROVIDERS
    max_results_per_provider: int = 10
    default_currency: str = "EUR"
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        _need(self.max_results_per_provider > 0, "max_results_per_provider must be positive")
        _need(bool(self.providers), "at least one provider must be configured")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> ScannerConfig:
        """From a mapping, or its ``scanner`` table; unknown keys are ignored."""
        section = data.get("scanner", data)
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in section.items() if k in known})

    @classmethod
    def from_toml(cls, path: str | Path) -> ScannerConfig:
        return cls.from_dict(tomllib.loads(Path(path).read_text()))


def load_scanner_config(path: str | Path | None = None) -> ScannerConfig:
    return ScannerConfig() if path is None else ScannerConfig.from_toml(path)


@dataclass(frozen=True)
class NormalizationConfig:
    unicode_form: str = "NFKC"
    remove_emoji: bool = True
    lowercase_title: bool = True
    remove_filler_words: bool = True
    filler_words: tuple[str, ...] | None = None
    default_currency: str | None = None
    currency_aliases: dict[str, str] | None = None
    location_aliases: dict[str, str] | None = None
    condition_aliases: dict[str, str] | None = None

    def __post_init__(self) -> None:
        _need(self.unicode_form in UNICODE_FORMS, f"'unicode_form' must be one of {', '.join(UNICODE_FORMS)}")

    def with_alias(self, kind: str, alias: str, value: str) -> NormalizationConfig:
        """This configuration and one more alias of a kind: currency, condition or location."""
        _need(bool(alias) and bool(value), "alias and value must be non-empty")
        default = {"currency": CURRENCY_ALIASES, "condition": CONDITION_ALIASES, "location": LOCATION_ALIASES}[kind]
        name = f"{kind}_aliases"
        known = getattr(self, name) or default
        return replace(self, **{name: known | {alias.lower(): value.upper() if kind == "currency" else value}})


@dataclass(frozen=True)
class ClassificationConfig:
    accessory_terms: tuple[str, ...] = ACCESSORY_TERMS
    part_terms: tuple[str, ...] = PART_TERMS
    excluded_terms: tuple[str, ...] = EXCLUDED_TERMS
    required_terms: tuple[str, ...] | None = None


@dataclass(frozen=True)
class MatchConfig:
    same_threshold: float = 0.72
    possible_threshold: float = 0.45
    overlap_weight: float = 0.35
    model_conflict_cap: float = 0.30
    brand_conflict_factor: float = 0.45
    shared_model_boost: float = 0.40
    shared_brand_boost: float = 0.15
    brands: tuple[str, ...] = BRANDS

    def __post_init__(self) -> None:
        _need(0 <= self.possible_threshold <= self.same_threshold <= 1, "thresholds must satisfy 0 <= possible <= same <= 1")
        _need(0 <= self.overlap_weight <= 1, "overlap_weight must be in [0, 1]")


@dataclass(frozen=True)
class DeduplicationConfig:
    enabled: bool = True
    include_possible_matches: bool = False
    match_config: MatchConfig = MatchConfig()
    provider_priority: tuple[str, ...] = ()


@dataclass(frozen=True)
class PairStrategy:
    """A price strategy in Python: ``update(state, prices, counts)`` adds arrays of distinct prices, ascending, with their counts to a state of
    bounded size, ``merge`` adds two states up, ``finish`` gives the price or None. States are pickled between tasks."""

    name: str
    start: Callable[[], Any]
    update: Callable[[Any, Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


@dataclass(frozen=True)
class PricingConfig:
    """``strategy`` is a name, a function from the price and weight columns to an aggregate, or one in Python."""

    strategy: str | Callable[[Column, Column], Column] | PairStrategy = "median"
    trim_fraction: float = 0.1
    min_comparables: int = 3
    remove_outliers: bool = True
    iqr_multiplier: float = 1.5
    currency: str | None = None
    confidence_full_count: int = 5

    @property
    def strategy_name(self) -> str:
        if isinstance(self.strategy, str):
            return self.strategy
        return self.strategy.name if isinstance(self.strategy, PairStrategy) else getattr(self.strategy, "__name__", "custom")

    def __post_init__(self) -> None:
        _need(callable(self.strategy) or isinstance(self.strategy, PairStrategy) or self.strategy in STRATEGIES, f"'strategy' must be one of {', '.join(STRATEGIES)}")
        _need(0 <= self.trim_fraction < 0.5, "trim_fraction must be in [0, 0.5)")
        _need(self.min_comparables >= 1, "min_comparables must be >= 1")
        _need(self.iqr_multiplier > 0, "iqr_multiplier must be positive")
        _need(self.confidence_full_count >= 1, "confidence_full_count must be >= 1")


@dataclass(frozen=True)
class OpportunityConfig:
    marketplace_fee_rate: float = 0.10
    payment_fee_rate: float = 0.029
    payment_fee_flat: float = 0.35
    shipping_cost: float = 10.0
    packaging_cost: float = 2.0
    buffer_rate: float = 0.05
    buffer_flat: float = 0.0
    tax_rate: float = 0.0
    strong_buy_roi: float = 0.30
    buy_roi: float = 0.15
    watch_roi: float = 0.05
    min_net_profit: float = 0.0
    min_confidence: float = 0.40
    strong_buy_confidence: float = 0.60
    require_same_currency: bool = True

    def __post_init__(self) -> None:
        for name in ("marketplace_fee_rate", "payment_fee_rate", "buffer_rate", "tax_rate", "min_confidence", "strong_buy_confidence"):
            _need(0 <= getattr(self, name) <= 1, f"{name} must be in [0, 1], got {getattr(self, name)}")
        for name in ("payment_fee_flat", "shipping_cost", "packaging_cost", "buffer_flat", "min_net_profit"):
            _need(getattr(self, name) >= 0, f"{name} must be non-negative")
        _need(0 <= self.watch_roi <= self.buy_roi <= self.strong_buy_roi, "ROI thresholds must satisfy 0 <= watch <= buy <= strong_buy")


@dataclass(frozen=True)
class ScoringConfig:
    roi_weight: float = 0.35
    net_profit_weight: float = 0.25
    confidence_weight: float = 0.25
    risk_weight: float = 0.15
    roi_reference: float = 30.0
    net_profit_reference: float = 200.0
    risk_dispersion_reference: float = 1.0
    risk_full_comparables: int = 5

    def __post_init__(self) -> None:
        for name in ("roi_weight", "net_profit_weight", "confidence_weight", "risk_weight"):
            _need(getattr(self, name) >= 0, f"{name} must be non-negative")
        _need(self.total_weight > 0, "at least one weight must be positive")
        for name in ("roi_reference", "net_profit_reference", "risk_dispersion_reference"):
            _need(getattr(self, name) > 0, f"{name} must be positive")
        _need(self.risk_full_comparables >= 1, "risk_full_comparables must be >= 1")

    @property
    def total_weight(self) -> float:
        return self.roi_weight + self.net_profit_weight + self.confidence_weight + self.risk_weight


@dataclass(frozen=True)
class ComparisonConfig:
    epsilon: float = 1e-9


@dataclass(frozen=True)
class PipelineConfig:
    scanner: ScannerConfig = ScannerConfig()
    normalization: NormalizationConfig = NormalizationConfig()
    classification: ClassificationConfig = ClassificationConfig()
    deduplication: DeduplicationConfig = DeduplicationConfig()
    pricing: PricingConfig = PricingConfig()
    opportunity: OpportunityConfig = OpportunityConfig()
    scoring: ScoringConfig = ScoringConfig()
    scan_limit: int | None = None
    live_providers: dict[str, dict[str, Any]] = field(default_factory=dict)


def _typed(section: str, key: str, value: Any, kind: Any) -> Any:
    """value as the annotated kind; a bool is no number, a list becomes a tuple."""
    options = typing.get_args(kind) if isinstance(kind, types.UnionType) else (kind,)
    for one in options:
        origin = typing.get_origin(one) or one
        if origin is float and isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
        if origin is int and isinstance(value, int) and not isinstance(value, bool):
            return value
        if origin in (bool, str) and type(value) is origin:
            return value
        if origin is tuple and isinstance(value, list) and all(isinstance(x, str) for x in value):
            return tuple(value)
        if origin is dict and isinstance(value, dict) and all(isinstance(x, str) for x in value.values()):
            return dict(value)
    words = {float: "a number", int: "an integer", bool: "a boolean", str: "a string", tuple: "a list of strings", dict: "a table of string -> string"}
    wanted = next(words[o] for one in options if (o := typing.get_origin(one) or one) in words)
    raise ConfigError(f"[{section}] '{key}' must be {wanted}")


def section_config(cls: type, section: str, data: Mapping[str, Any], skip: tuple[str, ...] = (), **extra: Any) -> Any:
    """A config dataclass from one TOML table; unknown keys and wrong types are errors."""
    hints = typing.get_type_hints(cls)
    known = {f.name for f in fields(cls) if f.name not in skip}
    if unknown := sorted(set(data) - known):
        raise ConfigError(f"[{section}] unknown key(s): {', '.join(unknown)}")
    values = {k: _typed(section, k, v, hints[k]) for k, v in data.items()}
    if missing := sorted(f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING and f.name not in values | extra):
        raise ConfigError(f"[{section}] missing key(s): {', '.join(missing)}")
    try:
        return cls(**values, **extra)
    except ValueError as e:
        raise ConfigError(f"[{section}] {e}") from e


def load_pipeline_config(path: str | Path) -> PipelineConfig:
    """The configuration in a TOML file; unknown sections and keys are errors."""
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"config file not found: {path}")
    try:
        raw = tomllib.loads(path.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"invalid TOML in {path}: {e}") from e
    allowed = {"pipeline", "scanner", "normalization", "matching", "deduplication", "market_pricing", "opportunity", "scoring", "providers"}
    if unknown := sorted(set(raw) - allowed):
        raise ConfigError(f"unknown section(s): {', '.join(unknown)}; allowed: {', '.join(sorted(allowed))}")
    out: dict[str, Any] = {}
    for name, target, cls, skip in (
        ("scanner", "scanner", ScannerConfig, ()),
        ("normalization", "normalization", NormalizationConfig, ("condition_aliases",)),
        ("market_pricing", "pricing", PricingConfig, ()),
        ("opportunity", "opportunity", OpportunityConfig, ()),
        ("scoring", "scoring", ScoringConfig, ()),
    ):
        if name in raw:
            out[target] = section_config(cls, name, raw[name], skip)
    if "deduplication" in raw or "matching" in raw:
        match = section_config(MatchConfig, "matching", raw.get("matching", {}))
        out["deduplication"] = section_config(DeduplicationConfig, "deduplication", raw.get("deduplication", {}), ("match_config",), match_config=match)
    pipeline = raw.get("pipeline", {})
    if unknown := sorted(set(pipeline) - {"scan_limit"}):
        raise ConfigError(f"[pipeline] unknown key(s): {', '.join(unknown)}")
    if "scan_limit" in pipeline:
        out["scan_limit"] = _typed("pipeline", "scan_limit", pipeline["scan_limit"], int)
    if "providers" in raw:
        from .sources.live import check_live_settings

        out["live_providers"] = check_live_settings(raw["providers"])
    return PipelineConfig(**out)
