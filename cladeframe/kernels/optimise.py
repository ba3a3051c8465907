"""Bounded one-dimensional and coordinate-wise optimisation of model parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..sources.newick import Tree
from .likelihood import Likelihood
from .models import gtr

RATIO = (5**0.5 - 1) / 2


def golden(f: Callable[[float], float], low: float, high: float, precision: float = 1e-4) -> tuple[float, float]:
    """The place and value of a maximum of f in [low, high]."""
    a, b = low, high
    p, q = b - RATIO * (b - a), a + RATIO * (b - a)
    fp, fq = f(p), f(q)
    while b - a > precision:
        if fp > fq:
            b, q, fq = q, p, fp
            p = b - RATIO * (b - a)
            fp = f(p)
        else:
            a, p, fp = p, q, fq
            q = a + RATIO * (b - a)
            fq = f(q)
    return (p, fp) if fp > fq else (q, fq)


def optimise_gtr(masks: np.ndarray, taxa: list[str], counts: np.ndarray, tree: Tree, freqs: list[float], *, rates: list[float] | None = None, gamma: bool = False, invariant: bool = False, n_classes: int = 4, passes: int = 30, precision: float = 0.01) -> tuple[dict, float]:
    """Maximise lnL over exchange rates (GT fixed to 1), frequencies, the shape and the share of invariant
    sites, each in turn by golden section in its logarithm or logit, with the branches between passes."""
    x = {"rates": list(rates or [1.0] * 5), "freqs": list(freqs), "alpha": 0.5 if gamma else None, "pinv": 0.1 if invariant else 0.0}

    def data(p: dict) -> Likelihood:
        f = np.array(p["freqs"]) / sum(p["freqs"])
        return Likelihood(masks, taxa, counts, gtr([*p["rates"], 1.0], f, alpha=p["alpha"], n_classes=n_classes, pinv=p["pinv"]))

    best = data(x).optimise_branches(tree, passes=2)
    for _ in range(passes):
        start = best

        def along(put: Callable[[dict, float], dict], now: float, low: float, high: float) -> None:
            nonlocal x, best
            at, value = golden(lambda v: data(put(x, v)).lnl(tree), max(low, now - 1.5), min(high, now + 1.5), 1e-3)
            if value > best:
                x, best = put(x, at), value

        for i in range(5):
            along(lambda p, v, i=i: p | {"rates": [np.exp(v) if j == i else r for j, r in enumerate(p["rates"])]}, np.log(x["rates"][i]), -7.0, 7.0)
        for i in range(3):
            along(lambda p, v, i=i: p | {"freqs": [np.exp(v) * p["freqs"][3] if j == i else r for j, r in enumerate(p["freqs"])]}, np.log(x["freqs"][i] / x["freqs"][3]), -4.0, 4.0)
        if gamma:
            along(lambda p, v: p | {"alpha": float(np.exp(v))}, np.log(x["alpha"]), np.log(0.05), np.log(200))
        if invariant:
            along(lambda p, v: p | {"pinv": float(1 / (1 + np.exp(-v)))}, np.log(x["pinv"] / (1 - x["pinv"])), -6.0, 3.0)
        best = data(x).optimise_branches(tree, passes=2)
        if best - start < precision:
            break
    x["freqs"] = [f / sum(x["freqs"]) for f in x["freqs"]]
    return x, best


def bracket(f: Callable[[float], float], x: float, step: float, low: float, high: float) -> tuple[float, float, float]:
    """Three places, the middle one no worse than the others, by strides that grow from x; or one at a bound."""
    a, b = x, min(max(x + step, low), high)
    fa, fb = f(a), f(b)
    if fb < fa:
        a, b, fa, fb = b, a, fb, fa
    while True:
        c = min(max(b + 1.618 * (b - a), low), high)
        if c == b or f(c) <= fb:
            return a, b, c
        a, b, fb = b, c, f(c)


def brent(f: Callable[[float], float], low: float, high: float, precision: float = 1e-6, rounds: int = 100) -> tuple[float, float]:
    """The place and value of a maximum of f in [low, high], by parabolas where they help and golden sections elsewhere."""
    a, b = min(low, high), max(low, high)
    x = w = v = a + (1 - RATIO) * (b - a)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(rounds):
        mid, tol = (a + b) / 2, precision * abs(x) + 1e-12
        if abs(x - mid) <= 2 * tol - (b - a) / 2:
            break
        use = False
        if abs(e) > tol:
            r, q = (x - w) * (fv - fx), (x - v) * (fw - fx)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(q * e / 2) and q * (a - x) < p < q * (b - x):
                e, d, use = d, p / q, True
        if not use:
            e = (b - x) if x < mid else (a - x)
            d = (1 - RATIO) * e
        u = x + (d if abs(d) >= tol else (tol if d > 0 else -tol))
        fu = f(u)
        if fu >= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu >= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu >= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def optimise_scale(score: Callable[[Tree], float], tree: Tree) -> float:
    """Multiply all branches by the best factor; returns the score."""
    lengths = list(tree.length)

    def scaled(x: float) -> float:
        tree.length = [None if t is None else t * float(np.exp(x)) for t in lengths]
        return score(tree)

    at, value = brent(scaled, -2.0, 2.0, 1e-5)
    return scaled(at)


def optimise_rates(make: Callable[[list[float]], float], sizes: list[float], rates: list[float], passes: int = 5) -> tuple[list[float], float]:
    """Rates of subsets that maximise a score, with a mean of 1 over all sites."""
    def mean_one(r: list[float]) -> list[float]:
        k = sum(x * n for x, n in zip(r, sizes)) / sum(sizes)
        return [x / k for x in r]

    rates, best = mean_one(rates), make(mean_one(rates))
    for _ in range(passes):
        start = best
        for i in range(len(rates)):
            put = lambda x, i=i: mean_one([float(np.exp(x)) if j == i else r for j, r in enumerate(rates)])
            at, value = brent(lambda x: make(put(x)), float(np.log(rates[i])) - 1.5, float(np.log(rates[i])) + 1.5, 1e-4)
            if value > best:
                rates, best = put(at), value
        if best - start < 1e-3:
            break
    return rates, best


def mutated(value: list[float], rng: np.random.Generator, shape: float = 1000.0) -> list[float]:
    """One of some positive parameters times a gamma variate of mean 1; their sum stays."""
    out = list(value)
    i = int(rng.integers(len(out)))
    out[i] *= float(rng.gamma(shape, 1 / shape))
    return [x * sum(value) / sum(out) for x in out] if len(out) > 1 else out
