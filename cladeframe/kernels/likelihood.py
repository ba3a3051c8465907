"""Tree likelihoods of site patterns by pruning, with branch optimisation and ancestral states."""

from __future__ import annotations

import numpy as np

from ..sources.newick import Tree
from .models import Model

#: Bounds of branch lengths.
SHORTEST, LONGEST = 1e-8, 100.0
START = 0.05


class Likelihood:
    """Patterns are state masks (taxon, pattern); conditioned patterns (Mkv) are given as masks as well."""

    def __init__(self, masks: np.ndarray, taxa: list[str], counts: np.ndarray, model: Model, conditioned: np.ndarray | None = None, rate: float = 1.0):
        """``rate`` is the subset's own rate: its branches are so many times as long as the tree's."""
        self.rate = rate
        self.model, self.counts, self.n = model, np.asarray(counts, float), masks.shape[1]
        self.conditioned = 0 if conditioned is None else conditioned.shape[1]
        if self.conditioned:
            masks = np.concatenate((masks, conditioned), 1)
        self.states = len(model.freqs)
        bits = (masks[:, :, None] >> np.arange(self.states)) & 1
        self.tips = {name: bits[i].astype(float) for i, name in enumerate(taxa)}
        self.constant = np.bitwise_and.reduce(masks, axis=0)

    def _partials(self, tree: Tree, skip: int = -1) -> tuple[list, np.ndarray]:
        """Down-partials (class, pattern, state) of all nodes, children first, and the log scalers of the root."""
        kids, parts, scale = tree.children(), [None] * len(tree.parent), np.zeros(len(self.constant))
        for v in reversed(range(len(tree.parent))):
            if not kids[v]:
                tip = self.tips[tree.label[v]]
                parts[v] = np.broadcast_to(tip, (len(self.model.rates), *tip.shape))
                continue
            out = 1.0
            for k in kids[v]:
                p = self._p(tree.length[k] if tree.length[k] is not None else START)
                out = out * np.einsum("cij,csj->csi", p, parts[k])
            top = out.max((0, 2))
            top[top <= 0] = 1.0
            scale += np.log(top)
            parts[v] = out / top[None, :, None]
        return parts, scale

    def _sites(self, root: np.ndarray, scale: np.ndarray) -> np.ndarray:
        m = self.model
        varying = np.einsum("c,csi,i->s", m.weights, root, m.freqs)
        lnl = np.log(np.maximum(varying, 1e-300)) + scale
        if m.pinv:
            allowed = ((self.constant[:, None] >> np.arange(self.states)) & 1) @ m.freqs
            with np.errstate(divide="ignore"):
                lnl = np.logaddexp(lnl, np.log(m.pinv * allowed))
        if self.conditioned:
            hidden = np.exp(lnl[self.n :]).sum()
            lnl = lnl[: self.n] - np.log1p(-hidden)
        return lnl

    def site_lnl(self, tree: Tree) -> np.ndarray:
        parts, scale = self._partials(tree)
        return self._sites(parts[0], scale)

    def lnl(self, tree: Tree) -> float:
        return float(self.counts @ self.site_lnl(tree))

    def _outside(self, tree: Tree, parts: list) -> list:
        """For each node the partials of the rest of the tree at its parent's end of the branch."""
        kids, out = tree.children(), [None] * len(tree.parent)
        for v in range(len(tree.parent)):
            for k in kids[v]:
                x = 1.0 if v == 0 else np.einsum("cij,csi->csj", self._p(tree.length[v]), out[v])
                x = x * self.model.freqs if v == 0 else x
                for other in kids[v]:
                    if other != k:
                        x = x * np.einsum("cij,csj->csi", self._p(tree.length[other]), parts[other])
                top = np.max(x, (0, 2)) if not np.isscalar(x) else 1.0
                out[k] = x / np.where(top > 0, top, 1.0)[None, :, None] if not np.isscalar(x) else x
        return out

    def _p(self, t: float, order: int = 0) -> np.ndarray:
        return self.model.transition(t * self.rate, order) * self.rate**order

    def _combined(self, factors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The product of partials with their log scalers, scaled again."""
        out, scale = 1.0, 0.0
        for x, k in factors:
            out, scale = out * x, scale + k
        top = out.max((0, 2))
        top[top <= 0] = 1.0
        return out / top[None, :, None], scale + np.log(top)

    def _down(self, tree: Tree, kids: list[list[int]], parts: list, v: int) -> None:
        """Partials of a node with their log scalers, from its children's."""
        if kids[v]:
            parts[v] = self._combined([(np.einsum("cij,csj->csi", self._p(tree.length[k]), parts[k][0]), parts[k][1]) for k in kids[v]])
        else:
            tip = self.tips[tree.label[v]]
            parts[v] = (np.broadcast_to(tip, (len(self.model.rates), *tip.shape)), np.zeros(len(tip)))

    def curve(self, above: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray], t: float) -> tuple[float, float, float]:
        """lnL and its first two derivatives by the length of the branch between two partials. Invariant sites and
        conditioned patterns are taken into account."""
        m = self.model
        f, g, h = (np.einsum("c,csi,cij,csj->s", m.weights, above[0], self._p(t, k), below[0]) for k in range(3))
        scale, f = above[1] + below[1], np.maximum(f, 1e-300)
        lnl, d1, d2 = np.log(f) + scale, g / f, h / f
        if m.pinv:
            with np.errstate(divide="ignore"):
                inv = np.log(m.pinv * (((self.constant[:, None] >> np.arange(self.states)) & 1) @ m.freqs))
            total = np.logaddexp(lnl, inv)
            share = np.exp(lnl - total)
            lnl, d1, d2 = total, share * d1, share * d2
        n, c = self.n, self.counts
        out = [float(c @ lnl[:n]), float(c @ d1[:n]), float(c @ (d2[:n] - d1[:n] ** 2))]
        if self.conditioned:
            like = np.exp(lnl[n:])
            hid, hid1, hid2 = like.sum(), (like * d1[n:]).sum(), (like * d2[n:]).sum()
            total, left = c.sum(), 1 - hid
            out = [out[0] - total * np.log1p(-hid), out[1] + total * hid1 / left, out[2] + total * (hid2 * left + hid1 * hid1) / left**2]
        return tuple(out)

    def optimise_branches(self, tree: Tree, *, passes: int = 20, precision: float = 1e-4) -> float:
        return optimise_together([self], tree, passes=passes, precision=precision)

    def ancestral(self, tree: Tree, node: int) -> np.ndarray:
        """Posterior state probabilities (pattern, state) of an inner node."""
        parts, _ = self._partials(tree)
        if node == 0:
            joint = np.einsum("c,csi,i->si", self.model.weights, parts[0], self.model.freqs)
        else:
            above = np.einsum("cij,csi->csj", self._p(tree.length[node]), self._outside(tree, parts)[node])
            joint = np.einsum("c,csj,csj->sj", self.model.weights, above, parts[node])
        return (joint / joint.sum(1, keepdims=True))[: self.n]


def total_lnl(subsets: list[Likelihood], tree: Tree) -> float:
    """lnL of data in several subsets, each with its model and rate."""
    return sum(d.lnl(tree) for d in subsets)


def _newton(subsets: list[Likelihood], ends: list[tuple], t: float) -> float:
    """The best length of a branch between the partials of each subset, by Newton steps that never lose."""
    score = lambda x: tuple(map(sum, zip(*[d.curve(a, b, x) for d, (a, b) in zip(subsets, ends)])))
    value = score(t)
    for _ in range(10):
        step = -value[1] / value[2] if value[2] < 0 else (t if value[1] > 0 else -t / 2)
        new = min(max(t + step, SHORTEST), LONGEST)
        nxt = score(new)
        while nxt[0] < value[0] and abs(new - t) > 1e-9:
            new = (new + t) / 2
            nxt = score(new)
        if nxt[0] < value[0]:
            break
        done = abs(new - t) < 1e-7
        t, value = new, nxt
        if done:
            break
    return t


def optimise_together(subsets: list[Likelihood], tree: Tree, *, passes: int = 20, precision: float = 1e-4) -> float:
    """Newton steps on each branch in turn until a pass gains less than ``precision``; returns lnL.

    A pass is one sweep up and one down the tree: partials of a subtree are made again once, when its branches are
    done, and those of the rest of the tree follow the way down.
    """
    for i, x in enumerate(tree.length):
        if tree.parent[i] >= 0:
            tree.length[i] = min(max(START if x is None else x, SHORTEST), LONGEST)
    kids, best = tree.children(), total_lnl(subsets, tree)
    for _ in range(passes):
        parts = [[None] * len(tree.parent) for _ in subsets]
        for d, p in zip(subsets, parts):
            for v in reversed(range(len(tree.parent))):
                d._down(tree, kids, p, v)
        # What lies above each node; a node is left when its subtree is done, and its partials are made again.
        above: list[list] = [[None] * len(tree.parent) for _ in subsets]
        todo = [(0, False)]
        while todo:
            v, done = todo.pop()
            if done:
                for d, p in zip(subsets, parts):
                    d._down(tree, kids, p, v)
                continue
            if v:
                for d, p, a in zip(subsets, parts, above):
                    up = tree.parent[v]
                    rest = [(np.einsum("cij,csj->csi", d._p(tree.length[k]), p[k][0]), p[k][1]) for k in kids[up] if k != v]
                    top = (np.broadcast_to(d.model.freqs, (len(d.model.rates), len(d.constant), d.states)), np.zeros(len(d.constant))) if up == 0 else (np.einsum("cij,csi->csj", d._p(tree.length[up]), a[up][0]), a[up][1])
                    a[v] = d._combined([top, *rest])
                tree.length[v] = _newton(subsets, [(a[v], p[v]) for p, a in zip(parts, above)], tree.length[v])
            if kids[v]:
                todo.append((v, True))
                todo += [(k, False) for k in reversed(kids[v])]
        now = total_lnl(subsets, tree)
        if now - best < precision:
            return now
        best = now
    return best
