"""Options of the commands, presets, and what overrides what: arguments, then the file, then a preset."""

from __future__ import annotations

from dataclasses import fields, replace
from typing import Any

from ..operators.detect import DetectOptions
from ..operators.filters import FilterOptions
from ..operators.local import BootstrapOptions, PruneOptions, WalkOptions

#: Count, ratio, least quality, least share, least coverage.
PRESETS = {"ultra": (1, 1e-6, 0.0, 0.0, 1), "high": (1, 1e-4, 5.0, 1e-5, 1), "standard": (2, 0.05, 10.0, 1e-4, 3), "strict": (3, 0.05, 20.0, 1e-3, 5)}
#: Names of a configuration file's tables and keys that detection and filtering read.
DETECT_KEYS = ("count", "ratio", "max_stack", "max_break", "max_node", "bidirectional", "adaptive", "cluster", "min_qual", "min_rvaf", "min_cov", "prune", "prune_min_count", "prune_error_rate", "prune_bubble_ratio", "bootstrap", "bootstrap_replicates", "bootstrap_confidence", "bootstrap_seed")


def preset(name: str) -> dict[str, Any]:
    if name not in PRESETS:
        raise ValueError(f"presets are {', '.join(PRESETS)}")
    return dict(zip(("count", "ratio", "min_qual", "min_rvaf", "min_cov"), PRESETS[name]))


def settled(config: dict, given: dict[str, Any], sensitivity: str | None = None) -> dict[str, Any]:
    """Settings of detection: given arguments win over the file, the file over a preset."""
    section = dict(config.get("detect", {}))
    own = dict(config.get("sensitivity", {}))
    name = sensitivity or own.pop("preset", None)
    own.pop("preset", None)
    out = preset(name) if name else {}
    renamed = {"min_coverage": "min_cov", "min_vaf": "min_rvaf"}
    out |= {renamed.get(k, k): v for k, v in {**section, **own}.items()}
    out |= {k: v for k, v in given.items() if v is not None}
    return {k: v for k, v in out.items() if k in DETECT_KEYS}


def detect_options(settings: dict[str, Any]) -> DetectOptions:
    s = dict(settings)
    walk = replace(WalkOptions(), **{f.name: s[f.name] for f in fields(WalkOptions) if f.name in s})
    prune = None
    if s.get("prune", True):
        prune = replace(PruneOptions(), **{n: s[f"prune_{n}"] for n in ("min_count", "error_rate", "bubble_ratio") if f"prune_{n}" in s})
    bootstrap = None
    if s.get("bootstrap"):
        bootstrap = replace(BootstrapOptions(), **{n: s[f"bootstrap_{n}"] for n in ("replicates", "confidence", "seed") if s.get(f"bootstrap_{n}") is not None})
    more = {n: s[n] for n in ("adaptive", "cluster", "min_qual", "min_rvaf", "min_cov") if n in s}
    return DetectOptions(walk=walk, prune=prune, bootstrap=bootstrap, **more)


def filter_options(config: dict, **given) -> FilterOptions:
    known = {f.name for f in fields(FilterOptions)}
    out = {k: tuple(v) if k == "types" else v for k, v in config.get("filter", {}).items() if k in known}
    return replace(FilterOptions(), **out | {k: v for k, v in given.items() if v is not None})
