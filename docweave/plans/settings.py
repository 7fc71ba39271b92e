"""Layered settings: given values, then environment, then a YAML file, then defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Environment variables look like ``DOCWEAVE__SECTION__KEY``.
ENV_PREFIX = "DOCWEAVE__"
SECRET_KEYS = ("api_key", "token", "password", "secret")


@dataclass(frozen=True)
class Extraction:
    enabled: bool = True
    base_url: str | None = None
    api_key: str | None = None
    model: str = "rules"
    temperature: float = 0.0
    timeout_s: float = 300.0
    retries: int = 2
    workers: int = 2
    contract: str = "dense"


@dataclass(frozen=True)
class Images:
    enabled: bool = True
    base_url: str | None = None
    api_key: str | None = None
    model: str = "none"
    timeout_s: float = 120.0
    max_tokens: int = 2000
    min_area: float = 0.0


@dataclass(frozen=True)
class Embedding:
    enabled: bool = True
    base_url: str | None = None
    api_key: str | None = None
    model: str = "hashing"
    dim: int = 1024
    batch: int = 64
    prefix: str = ""


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    merge_peers: bool = True
    furniture_prefixes: tuple[str, ...] = ()
    furniture_min_pages: int = 3
    furniture_band: float = 0.12


@dataclass(frozen=True)
class Parsing:
    ocr: bool = True
    languages: tuple[str, ...] = ("de", "en")
    heading_levels: bool = True
    dehyphenate: bool = True


@dataclass(frozen=True)
class Service:
    max_mb: int = 50
    deadline_s: float = 1800.0
    cache_dir: str | None = None
    ontology: str | None = None


@dataclass(frozen=True)
class Settings:
    extraction: Extraction = field(default_factory=Extraction)
    images: Images = field(default_factory=Images)
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    parsing: Parsing = field(default_factory=Parsing)
    service: Service = field(default_factory=Service)


def _typed(value: Any, default: Any) -> Any:
    if isinstance(default, bool) and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(v.strip() for v in value.split(",") if v.strip()) if isinstance(value, str) else tuple(value)
    if isinstance(default, (int, float)) and not isinstance(default, bool) and isinstance(value, str):
        return type(default)(value)
    return value


def load(given: Mapping[str, Mapping[str, Any]] | None = None, path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Unknown sections and keys are errors.  Image and embedding endpoints default to the extraction's."""
    layers: list[Mapping[str, Mapping[str, Any]]] = []
    if path and Path(path).exists():
        import yaml

        layers.append(yaml.safe_load(Path(path).read_text()) or {})
    from_env: dict[str, dict[str, Any]] = {}
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(ENV_PREFIX):
            section, _, key = name[len(ENV_PREFIX) :].lower().partition("__")
            from_env.setdefault(section, {})[key] = value
    layers += [from_env, given or {}]
    out = Settings()
    for layer in layers:
        for section, values in layer.items():
            current = getattr(out, section, None)
            if current is None:
                raise ValueError(f"unknown settings section {section!r}")
            known = {f.name for f in fields(current)}
            if unknown := set(values) - known:
                raise ValueError(f"unknown settings in {section}: {sorted(unknown)}")
            out = replace(out, **{section: replace(current, **{k: _typed(v, getattr(current, k)) for k, v in values.items()})})
    for section in ("images", "embedding"):
        own = getattr(out, section)
        out = replace(out, **{section: replace(own, base_url=own.base_url or out.extraction.base_url, api_key=own.api_key or out.extraction.api_key)})
    return out


def redacted(settings: Settings) -> dict[str, dict[str, Any]]:
    return {s: {k: "***" if k in SECRET_KEYS and v else v for k, v in values.items()} for s, values in asdict(settings).items()}


def redact(rows: DataFrame) -> DataFrame:
    """(key, shown): non-empty values of all keys are hidden."""
    return rows.select("key", F.when(F.col("value") != "", F.lit("***")).otherwise(F.col("value")).alias("shown"))
