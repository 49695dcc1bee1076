"""Settings as frozen dataclasses; every check raises ``ValueError`` on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from dataclasses import dataclass, field, fields, is_dataclass

# Names accepted by the matching and fusion settings.
ALIGNMENTS = ("pma", "diagonal", "soft_dtw", "none")
AGGREGATIONS = ("compatibility", "mean", "support_max", "uniform_lse", "similarity", "overlap", "prototype")
LSE_RULES = ("compatibility", "similarity", "overlap", "uniform_lse")
FUSIONS = ("uniform", "finest")
# Channel order of the bin features.
CHANNELS = ("down_bytes", "up_bytes", "down_packets", "up_packets", "down_mean_packet_length")


def validate_scales(scales, window=60.0) -> tuple[int, ...]:
    """Sorted distinct scales in ms; each divides the window and is a multiple of the finest."""
    total_ms = int(round(window * 1000))
    ordered = tuple(sorted({int(s) for s in scales}))
    if window <= 0 or not ordered or ordered[0] <= 0:
        raise ValueError("a positive window and at least one positive scale are required")
    for scale in ordered:
        if total_ms % scale:
            raise ValueError(f"scale {scale} does not divide the window")
        if scale % ordered[0]:
            raise ValueError(f"scale {scale} is not a multiple of the finest scale")
    return ordered


@dataclass(frozen=True)
class DataConfig:
    window: float = 60.0
    scales: tuple[int, ...] = (100, 500, 2000)
    tokens: int = 30
    fusion: str = "uniform"
    exclude_condition: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "scales", validate_scales(self.scales, self.window))
        if self.tokens < 1:
            raise ValueError("tokens must be positive")
        if self.fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {self.fusion}")

    def bins(self, scale: int) -> int:
        return int(round(self.window * 1000)) // scale


@dataclass(frozen=True)
class MatchConfig:
    alignment: str = "pma"
    aggregation: str = "compatibility"
    delta: float = 0.20
    gap: float = 0.10
    gamma: float = 0.10
    soft_dtw_gamma: float = 0.10
    lambda_z: float = 0.50
    beta_overlap: float = 1.0
    beta_similarity: float = 1.0
    tau_c: float = 0.20
    tau_s: float = 0.10
    epsilon: float = 1e-8
    block_rows: int = 128
    gallery_rows: int = 2048

    def __post_init__(self):
        if self.alignment not in ALIGNMENTS:
            raise ValueError(f"unknown alignment {self.alignment}")
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {self.aggregation}")
        for name in ("gamma", "soft_dtw_gamma", "tau_c", "tau_s", "epsilon"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.lambda_z <= 1:
            raise ValueError("lambda_z must be in [0, 1]")
        if min(self.gap, self.beta_overlap, self.beta_similarity) < 0:
            raise ValueError("gap and beta weights must not be negative")
        if min(self.block_rows, self.gallery_rows) < 1:
            raise ValueError("block sizes must be positive")
        _finite(self)


@dataclass(frozen=True)
class ViewConfig:
    prefix_min: float = 0.3
    warp_max: float = 0.3
    sigma: float = 2.0

    def __post_init__(self):
        if not 0 < self.prefix_min <= 1 or not 0 <= self.warp_max < 0.5 or self.sigma <= 0:
            raise ValueError("invalid view ranges")


@dataclass(frozen=True)
class Settings:
    data: DataConfig = field(default_factory=DataConfig)
    matching: MatchConfig = field(default_factory=MatchConfig)
    views: ViewConfig = field(default_factory=ViewConfig)


def with_updates(config, updates: dict):
    """Copy of ``config`` with nested updates; unknown keys are errors."""
    known = {f.name for f in fields(config)}
    values = {}
    for key, value in updates.items():
        if key not in known:
            raise ValueError(f"unknown setting {key}")
        current = getattr(config, key)
        if is_dataclass(current):
            if not isinstance(value, dict):
                raise ValueError(f"setting {key} needs a mapping")
            value = with_updates(current, value)
        values[key] = value
    return dataclasses.replace(config, **values)


def config_hash(config) -> str:
    """SHA-256 of the canonical JSON of a config or plain value."""
    value = dataclasses.asdict(config) if is_dataclass(config) else config
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def derived_seed(seed: int, *parts) -> int:
    """First 32 bits of the hash of the seed and its qualifying parts."""
    return int(config_hash([seed] + [str(p) for p in parts])[:8], 16)


def _finite(config):
    for f in fields(config):
        value = getattr(config, f.name)
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError(f"{f.name} must be finite")
