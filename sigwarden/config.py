"""Configuration from YAML files as nested objects with attribute access."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

# Defaults of the detectors and scores.
DEFAULTS = {
    "motion": {"amplitude_variance_threshold": 0.5, "high_freq_power_threshold": 0.4},
    "dropout": {"min_dropout_samples": 32, "zero_tolerance": 0.02},
    "noise_spike": {"z_threshold": 4.0},
    "flatline": {"min_flat_samples": 64, "variance_threshold": 1.0e-4},
    "timestamp": {"expected_jitter_ms": 5, "max_gap_factor": 3.0},
    "impossible_physiology": {"hr_bpm": [25, 220], "hrv_rmssd_ms": [1, 300]},
    "non_wear": {"min_minutes": 60, "motion_threshold": 0.05},
}


def _object(v):
    return SimpleNamespace(**{k: _object(x) for k, x in v.items()}) if isinstance(v, dict) else v


def _merged(base: dict, over: dict) -> dict:
    return base | {k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(*paths: str | Path) -> SimpleNamespace:
    """The defaults, overridden by each file in turn."""
    import yaml

    out = DEFAULTS
    for p in paths:
        out = _merged(out, yaml.safe_load(Path(p).read_text()) or {})
    return _object(out)


def resolve(path: str | Path, root: str | Path | None = None) -> Path:
    """An absolute path as it is, any other below ``root`` (by default the repository)."""
    p = Path(path)
    return p if p.is_absolute() else Path(root or Path(__file__).resolve().parents[1]) / p
