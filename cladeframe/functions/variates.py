"""Quantiles and random variates from uniform numbers, so that a stream of those decides all."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from ..kernels.models import gamma_quantile


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi_square_quantile(p: float, df: float) -> float:
    return 2 * gamma_quantile(p, df / 2)


def exponential(u: float, rate: float) -> float:
    return -math.log(u) / rate


def gamma(u: float, shape: float, scale: float = 1.0) -> float:
    return gamma_quantile(u, shape) * scale


def dirichlet(us: list[float], shapes: list[float]) -> list[float]:
    """Shares that sum to 1, one uniform number for each."""
    x = [gamma(u, a) for u, a in zip(us, shapes)]
    return [v / sum(x) for v in x]


def binomial(u: float, n: int, p: float) -> int:
    """The least k with a cumulative probability of u or more."""
    if p <= 0 or p >= 1:
        return 0 if p <= 0 else n
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
    return int(np.searchsorted(np.cumsum(np.exp(logs)), u))


def nearly_equal(a: float, b: float, tolerance: float = 1e-8) -> bool:
    return abs(a - b) < tolerance


def chunk_patterns(nodes: int, classes: int, states: int, budget_bytes: int) -> int:
    """Patterns that can be scored at once if the partials of all nodes are to stay below a budget."""
    return max(1, budget_bytes // (8 * nodes * classes * states))
