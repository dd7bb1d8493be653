"""Exchangeable implementations by stage and name."""

from __future__ import annotations

from collections.abc import Callable

from tesselith.operators import kernels, stacking

_ENGINES: dict[tuple[str, str], Callable] = {}


def register(stage: str, name: str, function: Callable) -> None:
    """Add an implementation, or put another in its place."""
    _ENGINES[stage, name] = function


def engine(stage: str, name: str) -> Callable:
    if (stage, name) not in _ENGINES:
        raise KeyError(f"{stage} has no {name}; there are {', '.join(names(stage)) or 'none'}")
    return _ENGINES[stage, name]


def names(stage: str) -> list[str]:
    return sorted(n for s, n in _ENGINES if s == stage)


register("flow.detector", "components", kernels.detect_stars)
register("flow.transform", "ransac", kernels.register)
register("align.warp", "nearest", lambda *a, **k: kernels.warp(*a, **k, order=0))
register("align.warp", "bilinear", kernels.warp)
for _kind in ("sigma", "mad", "winsor"):
    register("stack.reducer", _kind, lambda stack, keys, low=3.0, high=3.0, kind=_kind: stacking.reject(stack, keys, stacking.Rejection(kind, low, high)))
for _method in ("mean", "sum", "max", "min", "median"):
    register("stack.reducer", _method, lambda stack, keys, method=_method: stacking.combine(stack, keys, method))
