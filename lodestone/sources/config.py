"""Settings from TOML: every name known, every value checked, no value shown in an error."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Dedup:
    version_granularity: str = "operator"
    ambiguous_low: float = 0.55
    ambiguous_high: float = 0.80
    min_shared_roots: int = 1
    max_cluster_size: int = 500

    def __post_init__(self):
        if self.version_granularity not in ("exact", "upstream", "major", "operator"):
            raise ValueError("[dedup].version_granularity is not one of exact, upstream, major, operator")
        if not 0 <= self.ambiguous_low <= self.ambiguous_high <= 1:
            raise ValueError("[dedup].ambiguous_low and ambiguous_high must be a band within 0 to 1")
        if self.min_shared_roots < 1 or self.max_cluster_size < 2:
            raise ValueError("[dedup]: at least one shared root and two members")


@dataclass(frozen=True)
class Title:
    max_length: int = 120

    def __post_init__(self):
        if not 40 <= self.max_length <= 255:
            raise ValueError("[title].max_length must be 40 to 255")


@dataclass(frozen=True)
class Report:
    max_clusters: int = 50
    max_members_shown: int = 20
    max_cascade_shown: int = 12
    top_packages: int = 20


@dataclass(frozen=True)
class Rules:
    enabled: tuple[str, ...] | None = None
    disabled: tuple[str, ...] = ()
    max_findings: int = 12


@dataclass(frozen=True)
class Tracker:
    url: str = ""
    interval: float = 3.0
    max_pages: int = 40
    stale_days: int = 7
    max_rows: int = 20


@dataclass(frozen=True)
class Config:
    dedup: Dedup = field(default_factory=Dedup)
    title: Title = field(default_factory=Title)
    report: Report = field(default_factory=Report)
    rules: Rules = field(default_factory=Rules)
    tracker: Tracker = field(default_factory=Tracker)


SECTIONS = {"dedup": Dedup, "title": Title, "report": Report, "rules": Rules, "tracker": Tracker}


def find(start: Path, name: str = "lodestone.toml") -> Path | None:
    """The nearest settings file from a folder upwards."""
    for folder in (start.resolve(), *start.resolve().parents):
        if (folder / name).is_file():
            return folder / name
    return None


def load(path: Path | None = None) -> Config:
    if path is None:
        return Config()
    raw = tomllib.loads(path.read_text())
    parts = {}
    for section, values in raw.items():
        kind = SECTIONS.get(section)
        if kind is None or not isinstance(values, dict):
            raise ValueError(f"unknown section [{section}]")
        known = {f.name: f.default for f in fields(kind)}
        for name, value in values.items():
            if name not in known:
                raise ValueError(f"unknown setting [{section}].{name}")
            want = type(known[name])
            if isinstance(value, bool) or want in (int, float, str) and not isinstance(value, (int, float) if want is float else want):
                raise ValueError(f"[{section}].{name} has the wrong type")
        parts[section] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    return Config(**parts)
