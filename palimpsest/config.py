"""Engine settings: defaults, validation, and a signature that tells whether two memories were built alike."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

#: Settings that change retrieval only; memories built with other values can be used again.
RETRIEVAL_ONLY = frozenset({"topics", "episodes", "turns", "semantic_weight", "lexical_weight", "recency_weight", "temporal_bonus", "low_threshold", "high_threshold", "low_multiplier", "mid_multiplier", "high_multiplier", "max_items", "adaptive_strength"})


@dataclass(frozen=True)
class Settings:
    topics: int = 1
    episodes: int = 3
    turns: int = 5
    semantic_weight: float = 0.68
    lexical_weight: float = 0.24
    recency_weight: float = 0.08
    temporal_bonus: float = 0.10
    adaptive_strength: float = 0.35
    low_threshold: float = 0.40
    high_threshold: float = 0.70
    low_multiplier: float = 0.80
    mid_multiplier: float = 1.00
    high_multiplier: float = 1.55
    max_items: int | None = None
    cluster_distance: float = 0.30
    merge_similarity: float = 0.64
    topic_match: float = 0.62
    recluster_every: int = 16
    turn_window: int = 24
    episode_window: int = 8
    window_mode: str = "full"
    embedding_width: int = 256

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        for k in ("topics", "episodes", "turns"):
            put(k, max(0, int(getattr(self, k))))
        for k in ("low_multiplier", "mid_multiplier", "high_multiplier"):
            put(k, min(3.0, max(0.25, float(getattr(self, k)))))
        if not 0 <= self.low_threshold < self.high_threshold <= 1:
            raise ValueError("thresholds must be 0 <= low < high <= 1")
        if self.window_mode not in ("full", "recent"):
            raise ValueError(f"unknown window mode {self.window_mode!r}")
        w = [max(0.0, float(getattr(self, k))) for k in ("semantic_weight", "lexical_weight", "recency_weight")]
        w = [x / sum(w) for x in w] if sum(w) > 0 else [0.68, 0.24, 0.08]
        for k, x in zip(("semantic_weight", "lexical_weight", "recency_weight"), w, strict=True):
            put(k, x)

    @classmethod
    def of(cls, values: dict) -> Settings:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def signature(self, with_retrieval: bool = True) -> str:
        own = {k: v for k, v in asdict(self).items() if with_retrieval or k not in RETRIEVAL_ONLY}
        return hashlib.sha1(json.dumps(own, sort_keys=True).encode()).hexdigest()[:12]


def final_limits(topics: int, episodes: int, turns: int, multiplier: float, max_items: int | None = None) -> tuple[int, int, int]:
    """Scaled limits; over a cap the largest gives way, turns before episodes before topics."""
    import math

    out = [math.ceil(round(x * multiplier, 9)) for x in (topics, episodes, turns)]
    while max_items is not None and sum(out) > max(0, max_items):
        i = max(range(3), key=lambda k: (out[k], k))
        out[i] -= 1
    return out[0], out[1], out[2]


def cache_identity(parts: dict) -> str:
    """A readable path component and a hash of everything that made a memory."""
    text = json.dumps(parts, sort_keys=True, default=str)
    name = "".join(c if c.isalnum() or c in "-._" else "_" for c in str(parts.get("dataset", "memory")))[:60]
    return f"{name}-{hashlib.sha1(text.encode()).hexdigest()[:12]}"
