"""Settings of the stages, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

COMBINATIONS = ("mean", "sum", "max", "min", "median", "quality_weighted")
REJECTIONS = ("none", "sigma", "mad", "winsor")
SELECTIONS = ("all", "best_percentage", "multi_metric")


def _number(name: str, value: object, low: float = -math.inf, high: float = math.inf, open_low: bool = False) -> None:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} is no finite number")
    if value < low or value > high or (open_low and value == low):
        raise ValueError(f"{name} is out of range")


def _whole(name: str, value: object, low: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < low:
        raise ValueError(f"{name} must be a whole number of {low} or more")


def _one_of(name: str, value: object, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


@dataclass(frozen=True)
class StackSettings:
    combination: str = "median"
    rejection: str = "sigma"
    low: float = 3.0
    high: float = 3.0

    def __post_init__(self) -> None:
        _one_of("combination", self.combination, COMBINATIONS)
        _one_of("rejection", self.rejection, REJECTIONS)
        _number("low", self.low, 0, open_low=True)
        _number("high", self.high, 0, open_low=True)


@dataclass(frozen=True)
class SelectionSettings:
    method: str = "all"
    percent: float = 80.0
    least_roundness: float = 0.6
    least_stars: int = 8
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _one_of("method", self.method, SELECTIONS)
        _number("percent", self.percent, 0, 100, open_low=True)
        _number("least_roundness", self.least_roundness, 0, 1)
        _whole("least_stars", self.least_stars, 1)
        for name, weight in self.weights.items():
            _number(f"weight of {name}", weight, 0, open_low=True)
        if self.method == "multi_metric" and not self.weights:
            raise ValueError("multi_metric needs weights")


@dataclass(frozen=True)
class SessionSettings:
    gap_minutes: float = 15.0
    drift_factor: float = 3.0
    review_sigma: float = 2.0

    def __post_init__(self) -> None:
        for name in ("gap_minutes", "drift_factor", "review_sigma"):
            _number(name, getattr(self, name), 0, open_low=True)


@dataclass(frozen=True)
class HdrSettings:
    noise_floor: float = 1.0
    disagreement: float = 5.0

    def __post_init__(self) -> None:
        _number("noise_floor", self.noise_floor, 0, open_low=True)
        _number("disagreement", self.disagreement, 0, open_low=True)
