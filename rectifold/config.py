"""Thresholds and rules, with defaults; a YAML file may override any of them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.text import CONFIG_MISSING


@dataclass
class Config:
    auto_threshold: float = 0.95
    suggest_threshold: float = 0.70
    category_similarity: float = 82.0
    near_duplicate_similarity: float = 90.0
    z_threshold: float = 3.0
    iqr_factor: float = 1.5
    contamination: float = 0.05
    missing_tokens: tuple[str, ...] = CONFIG_MISSING
    domain_rules: dict[str, tuple[float | None, float | None]] = field(default_factory=lambda: {"age": (0, 120), "percentage": (0, 100), "salary": (0, None)})
    weights: dict[str, float] = field(default_factory=lambda: {"completeness": 0.25, "uniqueness": 0.20, "validity": 0.25, "consistency": 0.15, "anomaly": 0.15})


def load_config(path: str | None = None) -> Config:
    """The configuration of a YAML file (flat or in sections); unknown keys are ignored, a missing file gives the defaults."""
    out = Config()
    if not path or not Path(path).exists():
        return out
    import yaml

    flat: dict = {}
    for k, v in (yaml.safe_load(Path(path).read_text()) or {}).items():
        if isinstance(v, dict) and k not in ("domain_rules", "weights"):
            flat |= v
        else:
            flat[k] = v
    for f in fields(out):
        if f.name in flat:
            v = flat[f.name]
            if f.name == "missing_tokens":
                v = tuple(dict.fromkeys(str(x).strip().lower() for x in v))
            elif f.name == "domain_rules":
                v = {k: (r.get("min"), r.get("max")) if isinstance(r, dict) else tuple(r) for k, r in v.items()}
            setattr(out, f.name, v)
    return out
