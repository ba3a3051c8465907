"""A population of trees that are mutated, recombined and selected by likelihood, with a state that can be saved."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np

from ..sources.newick import Tree, parse_newick, write_newick
from .search import interchanges, recombined, regrafts, scaled, splits, with_lengths_mutated

#: Kinds of mutations, and the weight each keeps at least.
MOVES = ("nni", "spr_random", "spr_limited", "branch", "recombine")
FLOOR = 0.02


@dataclass
class Settings:
    size: int = 4
    holdover: int = 1
    intensity: float = 0.5
    interval: int = 100
    stored: int = 5
    reach: int = 6
    topology_patience: int = 10_000
    score_patience: float = 0.05
    least_gain: float = 0.01
    generations: int = 5_000_000
    seed: int = 1


@dataclass
class State:
    """All that a search needs to go on: trees with scores, the moves' records of the last intervals, and counters."""

    trees: list[str]
    scores: list[float]
    generation: int = 0
    improved: int = 0
    tried: list[list[int]] = field(default_factory=list)
    gained: list[list[float]] = field(default_factory=list)
    best_before: list[float] = field(default_factory=list)
    log: list[tuple[int, float]] = field(default_factory=list)
    random: dict | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def probabilities(tried: list[list[int]], gained: list[list[float]], prior: float = 0.5) -> np.ndarray:
    """Of each kind of move: mean gain for each try of the stored intervals and a prior, floored and normalised."""
    n, g = np.sum(tried, axis=0) if tried else np.zeros(len(MOVES)), np.sum(gained, axis=0) if gained else np.zeros(len(MOVES))
    raw = np.where(n > 0, g / np.maximum(n, 1), 0.0) + prior
    p = np.maximum(raw / raw.sum(), FLOOR)
    return p / p.sum()


def mutated(tree: Tree, other: Tree, move: str, rng: np.random.Generator, s: Settings) -> Tree:
    if move == "branch":
        return with_lengths_mutated(tree, rng)
    if move == "recombine":
        return recombined(tree, other, rng)
    options = interchanges(tree) if move == "nni" else regrafts(tree, s.reach if move == "spr_limited" else len(tree.parent))
    return options[int(rng.integers(len(options)))] if options else copy.deepcopy(tree)


def evolve(score: Callable[[Tree], float], optimise: Callable[[Tree], float], start: list[Tree], settings: Settings = Settings(), *, state: State | None = None, allow: Callable[[Tree], bool] | None = None, stop_after: int | None = None) -> State:
    """Generations until nothing improves any more, or for ``stop_after`` of them; a state that was returned can go on.

    The ``holdover`` best live on. Each other child descends from an individual drawn by its score, and is mutated
    by a move drawn by what moves of its kind gained lately; a new topology's branches are adjusted by ``optimise``. A search
    ends when no topology improved the best by ``least_gain`` for ``topology_patience`` generations, and the score gained
    less than ``score_patience`` over the stored intervals.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    if state is None:
        trees = [copy.deepcopy(start[i % len(start)]) for i in range(s.size)]
        state = State([], [optimise(t) for t in trees], tried=[[0] * len(MOVES)], gained=[[0.0] * len(MOVES)])
    else:
        trees = [parse_newick(t) for t in state.trees]
        state = copy.deepcopy(state)
        if state.random:
            rng.bit_generator.state = state.random
    taxa = sorted(x for x in trees[0].label if x)
    until = min(s.generations, state.generation + (stop_after or s.generations))
    while state.generation < until:
        by = sorted(range(len(trees)), key=lambda i: -state.scores[i])
        trees, scores = [trees[i] for i in by], [state.scores[i] for i in by]
        weight = np.exp(-s.intensity * (scores[0] - np.array(scores)))
        weight, chance = weight / weight.sum(), probabilities(state.tried, state.gained)
        children, values, best = trees[: s.holdover], scores[: s.holdover], scores[0]
        for _ in range(s.size - s.holdover):
            i, k = int(rng.choice(len(trees), p=weight)), int(rng.choice(len(MOVES), p=chance))
            child = mutated(trees[i], trees[int(rng.integers(len(trees)))], MOVES[k], rng, s)
            if allow is not None and not allow(child):
                child, value = copy.deepcopy(trees[i]), scores[i]
            else:
                value = score(child) if MOVES[k] == "branch" else optimise(child)
            state.tried[-1][k] += 1
            state.gained[-1][k] += max(0.0, value - scores[i])
            if value > best + s.least_gain and splits(child, taxa) != splits(trees[0], taxa):
                state.improved = state.generation + 1
            children.append(child)
            values.append(value)
        trees, state.scores = children, values
        state.generation += 1
        if state.generation % s.interval == 0:
            now = max(state.scores)
            state.log.append((state.generation, now))
            state.best_before = [*state.best_before, now][-s.stored - 1 :]
            state.tried, state.gained = [*state.tried, [0] * len(MOVES)][-s.stored :], [*state.gained, [0.0] * len(MOVES)][-s.stored :]
            still = len(state.best_before) > s.stored and now - state.best_before[0] < s.score_patience
            if still and state.generation - state.improved >= s.topology_patience:
                break
    state.trees, state.random = [write_newick(t, 12) for t in trees], rng.bit_generator.state
    return state


def perturbed(tree: Tree, rng: np.random.Generator, times: int = 3) -> Tree:
    """Some random interchanges one after the other, to leave a local optimum."""
    for _ in range(times):
        options = interchanges(tree)
        tree = options[int(rng.integers(len(options)))] if options else tree
    return scaled(tree, 1.0)
