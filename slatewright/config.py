"""Parameters of feed queries.  Their values become literals of the plans.  Names and
defaults of the fields are fixed values: configurations are exchanged by them."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

STRATEGIES = ("mmr", "calibrated")
COMPONENTS = ("interest", "freshness", "quality", "novelty", "popularity", "exploration")


@dataclass(frozen=True)
class FeedConfig:
    size: int = 10
    interest_weight: float = 0.45
    freshness_weight: float = 0.20
    quality_weight: float = 0.15
    novelty_weight: float = 0.10
    popularity_weight: float = 0.10
    exploration_weight: float = 0.02
    article_half_life_hours: float = 72.0
    profile_half_life_days: float = 30.0
    mmr_lambda: float = 0.78
    rerank_strategy: str = "mmr"
    calibration_weight: float = 0.5
    max_per_source: int = 2
    minimum_score: float = 0.0
    exclude_seen: bool = True
    view_signal: float = 0.2
    click_signal: float = 0.7
    like_signal: float = 1.0
    hide_signal: float = -1.2

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a positive integer")
            if f.type == "float" and (isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value)):
                raise ValueError(f"{f.name} must be a finite number")
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} must be true or false")
        if min(self.article_half_life_hours, self.profile_half_life_days) <= 0:
            raise ValueError("a half-life is greater than zero")
        for name in ("mmr_lambda", "calibration_weight", "minimum_score"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        weights = list(self.weights().values())
        if min(weights) < 0 or not 0 < sum(weights) < math.inf:
            raise ValueError("ranking weights must be non-negative with a positive sum")
        if self.rerank_strategy not in STRATEGIES:
            raise ValueError(f"unknown rerank_strategy; known: {', '.join(STRATEGIES)}")

    def weights(self) -> dict[str, float]:
        return {c: getattr(self, f"{c}_weight") for c in COMPONENTS}

    def signals(self) -> dict[str, float]:
        return {k: getattr(self, f"{k}_signal") for k in ("view", "click", "like", "hide")}

    def with_(self, **changes: object) -> FeedConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, object]:
        return asdict(self)

    @classmethod
    def from_mapping(cls, values: Mapping[str, object]) -> FeedConfig:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**values)

    @classmethod
    def from_json(cls, text: str) -> FeedConfig:
        from .sources.strict_json import load

        value = load(text)
        if not isinstance(value, dict):
            raise ValueError("a config is a JSON object")
        return cls.from_mapping(value)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)


def policies(config: FeedConfig, k: int, catalog_size: int = 0) -> dict[str, FeedConfig]:
    """The full policy and three declared baselines; slates of k at least, and for the
    baselines a source cap that never binds (a slate's size does not)."""
    base = config.with_(size=max(config.size, k))
    free = base.with_(mmr_lambda=1.0, max_per_source=max(1, base.size, catalog_size))
    alone = lambda name: free.with_(**{f"{c}_weight": float(c == name) for c in COMPONENTS})
    return {"full": base, "relevance_only": free, "popularity": alone("popularity"), "recency": alone("freshness")}


def ablation(config: FeedConfig, name: str, catalog_size: int = 0) -> FeedConfig:
    """One ranking weight at zero, or slate diversity switched off."""
    if name == "slate_diversity":
        return config.with_(mmr_lambda=1.0, max_per_source=max(1, config.size, catalog_size))
    if name not in COMPONENTS:
        raise ValueError(f"unknown ablation: {name}")
    return config.with_(**{f"{name}_weight": 0.0})
