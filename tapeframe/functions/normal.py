"""The normal distribution on the driver."""

from __future__ import annotations

from statistics import NormalDist

_UNIT = NormalDist()


def cdf(x: float) -> float:
    return _UNIT.cdf(x)


def inverse(p: float) -> float:
    return _UNIT.inv_cdf(p)


def bonferroni_threshold(trials: int, alpha: float = 0.05) -> float:
    """|t| that the best of so many trials has to exceed."""
    return inverse(1 - alpha / (2 * max(trials, 1)))
