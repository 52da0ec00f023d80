"""Settings with defaults; a file's values may name environment variables and zero means the default."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


@dataclass
class Settings:
    dim: int = 1536
    window: int = 50
    gamma: float = 1.5
    min_tokens: int = 50
    max_tokens: int = 500
    token_budget: int = 4096
    forced_turns: int = 3
    min_gain: float = -0.5
    fallback: bool = True
    top_k: int = 20
    hops: int = 2
    eps: float = 0.3
    min_points: int = 3
    decay: float = 0.95
    idle_seconds: float = 900.0
    check_seconds: float = 60.0
    max_pending: int = 10
    batch: int = 100


# The names of the settings in a file, by section.
NAMES = {
    "qdrant.vector_size": "dim", "segmentation.window_size": "window", "segmentation.gamma": "gamma", "segmentation.min_episode_tokens": "min_tokens",
    "segmentation.max_episode_tokens": "max_tokens", "knapsack.token_budget": "token_budget", "knapsack.force_recent_turns": "forced_turns",
    "dig.min_score": "min_gain", "dig.fallback_enabled": "fallback", "retrieval.vector_top_k": "top_k", "retrieval.graph_max_hops": "hops",
    "consolidation.dbscan_epsilon": "eps", "consolidation.dbscan_min_points": "min_points", "consolidation.decay_rate": "decay",
    "consolidation.inactivity_timeout": "idle_seconds", "consolidation.check_interval": "check_seconds", "consolidation.max_unconsolidated": "max_pending",
}
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(value: str) -> float:
    """Of a duration such as 1m30s; a plain number counts seconds."""
    parts = re.findall(r"([\d.]+)(ms|s|m|h)", value)
    return sum(float(n) * UNITS[u] for n, u in parts) if parts else float(value)


def entries(text: str) -> dict[str, str]:
    """The scalars of nested ``key: value`` lines by their path; environment variables are put in first."""
    text = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda v: os.environ.get(v[1] or v[2], ""), text)
    out: dict[str, str] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        m = re.match(r"( *)([\w-]+) *:(?: +|$)(\"[^\"]*\"|'[^']*'|[^#]*)", line)
        if not m:
            continue
        while path and path[-1][0] >= len(m[1]):
            path.pop()
        value = m[3].strip()
        if value:
            out[".".join([*(k for _, k in path), m[2]])] = value.strip("\"'")
        else:
            path.append((len(m[1]), m[2]))
    return out


def load(text: str) -> Settings:
    """Settings of a file with sections, or of flat lines that name the fields; ``$NAME`` and ``${NAME}`` stand for the environment;
    unknown keys are ignored, a missing, empty, unreadable or zero value is the default; a switch may be false."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    out = Settings()
    for key, raw in entries(text).items():
        name = NAMES.get(key, key)
        if name not in kinds or not raw:
            continue
        if kinds[name] is bool:
            setattr(out, name, raw.lower() in ("true", "yes", "on", "1"))
            continue
        try:
            value = kinds[name](seconds(raw) if name.endswith("_seconds") else float(raw))
        except ValueError:
            continue
        if value:
            setattr(out, name, value)
    return out
