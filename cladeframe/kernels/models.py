"""Substitution models: rate matrices, transition probabilities, discrete gamma rates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, a: float) -> float:
    """x with gamma_p(a, x) = p, by bisection in the logarithm."""
    low, high = -700.0, math.log(a + 50 * math.sqrt(a) + 50)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(a, math.exp(mid)) < p else (low, mid)
    return math.exp((low + high) / 2)


def discrete_gamma(alpha: float, n: int) -> np.ndarray:
    """Means of n classes of equal probability of a gamma distribution of mean 1 and shape alpha."""
    if n == 1:
        return np.ones(1)
    cuts = [gamma_quantile(k / n, alpha) for k in range(1, n)]
    upto = np.array([0.0, *[gamma_p(alpha + 1, x) for x in cuts], 1.0])
    return np.diff(upto) * n


@dataclass
class Model:
    """A reversible model: symmetric exchange rates, frequencies, rate classes and invariant sites.

    ``pinv`` is the share of sites that cannot change; the classes then share the rest, and rates are
    scaled so that a branch's length is its expected number of changes for a site."""

    exchange: np.ndarray
    freqs: np.ndarray
    rates: np.ndarray
    weights: np.ndarray
    pinv: float = 0.0

    def __post_init__(self) -> None:
        pi = self.freqs / self.freqs.sum()
        q = self.exchange * pi
        np.fill_diagonal(q, 0)
        np.fill_diagonal(q, -q.sum(1))
        q /= -(pi * np.diag(q)).sum()
        root = np.sqrt(pi)
        symmetric = root[:, None] * q / root
        values, vectors = np.linalg.eigh((symmetric + symmetric.T) / 2)
        self.freqs, self.q, self._values = pi, q, values
        self._left, self._right = vectors / root[:, None], vectors.T * root

    def transition(self, t: float, order: int = 0) -> np.ndarray:
        """P(t) for each rate class, or its first or second derivative by t: (class, from, to)."""
        r = self.rates / (1 - self.pinv)
        scale = r[:, None] * self._values
        e = np.exp(scale * t) * scale**order
        p = np.einsum("ik,ck,kj->cij", self._left, e, self._right)
        return np.maximum(p, 0) if order == 0 else p


def gtr(rates: list[float], freqs: list[float], *, alpha: float | None = None, n_classes: int = 4, pinv: float = 0.0) -> Model:
    """General time-reversible nucleotide model; rates AC, AG, AT, CG, CT, GT."""
    x = np.zeros((4, 4))
    x[np.triu_indices(4, 1)] = rates
    return _with_gamma(x + x.T, np.array(freqs, float), alpha, n_classes, pinv)


def jukes_cantor(n_states: int = 4, **gamma) -> Model:
    return _with_gamma(np.ones((n_states, n_states)), np.full(n_states, 1 / n_states), gamma.get("alpha"), gamma.get("n_classes", 4), gamma.get("pinv", 0.0))


def mk(n_states: int, *, ordered: bool = False) -> Model:
    """k states of equal frequencies; ordered ones change by one step only."""
    x = np.ones((n_states, n_states))
    if ordered:
        i = np.arange(n_states)
        x = (np.abs(i[:, None] - i) == 1).astype(float)
    return _with_gamma(x, np.full(n_states, 1 / n_states), None, 1, 0.0)


def codon_model(exchange: np.ndarray, codon_freqs: np.ndarray, aa: str, omega: float) -> Model:
    """Codons (index 16 a + 4 b + c without stops): one base changes at its nucleotide rate, times omega
    where the amino acid changes. ``aa`` has 64 letters in that order, a stop being ``*``."""
    sense = [i for i in range(64) if aa[i] != "*"]
    x = np.zeros((len(sense), len(sense)))
    for m, i in enumerate(sense):
        for n, j in enumerate(sense):
            diff = [(i // s % 4, j // s % 4) for s in (16, 4, 1) if i // s % 4 != j // s % 4]
            if len(diff) == 1:
                x[m, n] = exchange[diff[0]] * (omega if aa[i] != aa[j] else 1.0)
    return _with_gamma(x, codon_freqs, None, 1, 0.0)


def hky(kappa: float, freqs: list[float], **gamma) -> Model:
    """Two rates: transitions A-G and C-T ``kappa`` times as fast as transversions."""
    return gtr([1, kappa, 1, 1, kappa, 1], freqs, **gamma)


def classed(classes: list[int], values: dict[int, float], freqs: list[float], **gamma) -> Model:
    """Exchange rates by class, as of ``rate_classes``: those of one class are equal."""
    return gtr([values[k] for k in classes], freqs, **gamma)


def flexible(model: Model, rates: list[float], shares: list[float]) -> Model:
    """Free rate classes: shares are made to sum to 1, rates to a mean of 1."""
    w = np.array(shares, float) / sum(shares)
    r = np.array(rates, float)
    return Model(model.exchange, model.freqs, r / (w @ r), w * (1 - model.pinv), model.pinv)


@dataclass
class Mixture:
    """Classes that differ in their rate matrix, not in speed alone. They are scaled together: a branch's length is the
    number of changes that a site has on average over the classes."""

    parts: list[Model]
    shares: np.ndarray

    def __post_init__(self) -> None:
        self.freqs, self.pinv = self.parts[0].freqs, 0.0
        speed = []
        for m in self.parts:
            q = m.exchange * m.freqs
            np.fill_diagonal(q, 0)
            speed.append(m.freqs @ q.sum(1))
        self.weights = np.array(self.shares, float) / np.sum(self.shares)
        self.rates = np.array(speed) / (self.weights @ np.array(speed))

    def transition(self, t: float, order: int = 0) -> np.ndarray:
        return np.concatenate([m.transition(t * r, order) * r**order for m, r in zip(self.parts, self.rates)])


def codon_mixture(exchange: np.ndarray, codon_freqs: np.ndarray, aa: str, omegas: list[float], shares: list[float]) -> Mixture:
    """Codons whose sites fall in classes of different omega, given in rising order."""
    if sorted(omegas) != list(omegas):
        raise ValueError("omegas must rise")
    return Mixture([codon_model(exchange, codon_freqs, aa, w) for w in omegas], np.array(shares, float))


def exchange_from_text(text: str, n_states: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Exchange rates as a lower triangle, row by row, and then the frequencies, as published matrices are given."""
    import re

    numbers = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)]
    need = n_states * (n_states - 1) // 2
    if len(numbers) < need + n_states:
        raise ValueError(f"{need + n_states} numbers are needed")
    x = np.zeros((n_states, n_states))
    x[np.tril_indices(n_states, -1)] = numbers[:need]
    f = np.array(numbers[need : need + n_states])
    return x + x.T, f / f.sum()


def amino_acid_model(exchange: np.ndarray | None, freqs: np.ndarray | None = None, **gamma) -> Model:
    """Amino acids in the order of the matrix; without one all exchanges are alike."""
    x = np.ones((20, 20)) if exchange is None else exchange
    f = np.full(20, 1 / 20) if freqs is None else np.array(freqs, float)
    return _with_gamma(x, f, gamma.get("alpha"), gamma.get("n_classes", 4), gamma.get("pinv", 0.0))


def _with_gamma(x: np.ndarray, freqs: np.ndarray, alpha: float | None, n_classes: int, pinv: float) -> Model:
    n = n_classes if alpha else 1
    return Model(x, freqs, discrete_gamma(alpha, n) if alpha else np.ones(1), np.full(n, (1 - pinv) / n), pinv)
