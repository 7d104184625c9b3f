"""Configuration: plain dataclasses, environment expansion, deep merging, validation."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass

from litloom.errors import ConfigurationError

_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand(value, env: dict[str, str] | None = None):
    """${NAME} and ${NAME:-default} in strings, through lists and dictionaries; an unset name without a default stays."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    return value


def merge(base: dict, over: dict) -> dict:
    """over laid on base, dictionary by dictionary."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _within(name: str, value, low, high, open_low: bool = False) -> None:
    if value is not None and not (value > low if open_low else value >= low) or value is not None and value > high:
        raise ConfigurationError(f"{name} must be in {'(' if open_low else '['}{low}, {high}]: {value}")


@dataclass
class ProviderConfig:
    enabled: bool = True
    rate_limit: float = 1.0
    timeout: float = 30.0
    max_results: int | None = None

    def __post_init__(self):
        _within("rate_limit", self.rate_limit, 0, 100, True)
        _within("timeout", self.timeout, 0, 300, True)


@dataclass
class DedupConfig:
    strategy: str = "conservative"
    fuzzy_threshold: int = 97
    max_year_gap: int = 1
    semantic_threshold: float = 0.92

    def __post_init__(self):
        if self.strategy not in ("conservative", "semantic"):
            raise ConfigurationError(f"unknown strategy {self.strategy!r}")
        _within("fuzzy_threshold", self.fuzzy_threshold, 0, 100)
        _within("semantic_threshold", self.semantic_threshold, 0, 1)


@dataclass
class ScreenerConfig:
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    include_groups: list[list[str]] = field(default_factory=list)
    models: list[str] = field(default_factory=list)


@dataclass
class ExtractionConfig:
    max_tokens: int = 6000
    batch_size: int = 3


@dataclass
class Config:
    year_min: int | None = None
    year_max: int | None = None
    language: str = "en"
    providers: dict[str, ProviderConfig] = field(default_factory=dict)
    dedup: DedupConfig = field(default_factory=DedupConfig)
    screener: ScreenerConfig = field(default_factory=ScreenerConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)

    def __post_init__(self):
        _within("year_min", self.year_min, 1900, 2100)
        _within("year_max", self.year_max, 1900, 2100)
        if self.year_min and self.year_max and self.year_min > self.year_max:
            raise ConfigurationError("year_min is after year_max")


def _build(kind, spec: dict):
    known = {f.name: f for f in fields(kind)}
    return kind(**{k: v for k, v in spec.items() if k in known})


def load(spec: dict, overrides: dict | None = None, env: dict[str, str] | None = None) -> Config:
    """Config of a dictionary as it comes from YAML or JSON; unknown keys are passed over."""
    spec = expand(merge(spec, overrides or {}), env)
    out = dict(spec)
    out["providers"] = {k: _build(ProviderConfig, v or {}) for k, v in (spec.get("providers") or {}).items()}
    for name, kind in (("dedup", DedupConfig), ("screener", ScreenerConfig), ("extraction", ExtractionConfig)):
        out[name] = _build(kind, spec.get(name) or {})
    return _build(Config, out)


def dump(config) -> dict:
    """The dictionary that load takes."""
    if is_dataclass(config):
        return {f.name: dump(getattr(config, f.name)) for f in fields(config)}
    if isinstance(config, dict):
        return {k: dump(v) for k, v in config.items()}
    return config
