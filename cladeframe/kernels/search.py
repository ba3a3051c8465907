"""Tree search on one data set: stepwise addition and nearest-neighbour interchanges, from a seed."""

from __future__ import annotations

import copy

import numpy as np

from ..sources.newick import Tree
from .likelihood import START, Likelihood


def star_of_three(taxa: list[str]) -> Tree:
    tree = Tree()
    tree.add(-1)
    for name in taxa:
        k = tree.add(0)
        tree.label[k], tree.length[k] = name, START
    return tree


def renumbered(tree: Tree) -> Tree:
    """Parents before children, as the kernels need."""
    kids, order, todo = tree.children(), [], [tree.parent.index(-1)]
    while todo:
        v = todo.pop()
        order.append(v)
        todo += reversed(kids[v])
    at = {v: i for i, v in enumerate(order)}
    return Tree([at[tree.parent[v]] if tree.parent[v] >= 0 else -1 for v in order], [tree.label[v] for v in order], [tree.length[v] for v in order])


def attach(tree: Tree, branch: int, taxon: str) -> Tree:
    """A new tip in the middle of the branch above node ``branch``."""
    out = copy.deepcopy(tree)
    mid = out.add(out.parent[branch])
    half = max((out.length[branch] or START) / 2, START / 10)
    out.length[mid], out.length[branch], out.parent[branch] = half, half, mid
    tip = out.add(mid)
    out.label[tip], out.length[tip] = taxon, START
    return renumbered(out)


def interchanges(tree: Tree) -> list[Tree]:
    """All trees one nearest-neighbour interchange away, two for each inner branch of a binary tree."""
    kids, out = tree.children(), []
    for v in range(1, len(tree.parent)):
        if kids[v]:
            for other in [k for k in kids[tree.parent[v]] if k != v][:1]:
                for inner in kids[v]:
                    t = copy.deepcopy(tree)
                    t.parent[other], t.parent[inner] = v, tree.parent[v]
                    out.append(renumbered(t))
    return out


def splits(tree: Tree, taxa: list[str]) -> frozenset[int]:
    """Inner splits as bit masks on the side of the first taxon."""
    bit, full, below = {t: 1 << i for i, t in enumerate(taxa)}, (1 << len(taxa)) - 1, [0] * len(tree.parent)
    for v in reversed(range(len(tree.parent))):
        if tree.label[v] in bit:
            below[v] |= bit[tree.label[v]]
        if tree.parent[v] >= 0:
            below[tree.parent[v]] |= below[v]
    sides = {b if b & 1 else full ^ b for b in below[1:]}
    return frozenset(b for b in sides if bin(b).count("1") > 1 and bin(full ^ b).count("1") > 1)


def allowed(tree: Tree, taxa: list[str], positive: frozenset[int], negative: frozenset[int]) -> bool:
    have = splits(tree, taxa)
    return positive <= have and not negative & have


def may_become_allowed(tree: Tree, taxa: list[str], positive: frozenset[int], negative: frozenset[int]) -> bool:
    """For a tree of some of the taxa: positive constraints, cut down to them, must fit all its splits. Negative
    ones are looked at when all taxa are there."""
    here = sum(1 << i for i, t in enumerate(taxa) if t in set(filter(None, tree.label)))
    if here == (1 << len(taxa)) - 1:
        return allowed(tree, taxa, positive, negative)
    sides = [s & here for s in splits(tree, taxa)]

    def fits(a: int, b: int) -> bool:
        return not a & b or not a & (here ^ b) or not (here ^ a) & b or not (here ^ a) & (here ^ b)

    return all(fits(p & here, s) for p in positive for s in sides)


def search(data: Likelihood, taxa: list[str], seed: int, *, attachments: int = 50, rounds: int = 50, positive: frozenset[int] = frozenset(), negative: frozenset[int] = frozenset()) -> tuple[Tree, float]:
    """Random order of taxa; each goes where lnL is best among at most ``attachments`` branches; then
    interchanges as long as one of them gains, the likeliest tried first. Constraints are checked before anything is scored."""
    rng = np.random.default_rng(seed)
    order = [taxa[i] for i in rng.permutation(len(taxa))]
    tree = star_of_three(order[:3])
    for name in order[3:]:
        places = rng.permutation(np.arange(1, len(tree.parent)))[:attachments]
        options = [attach(tree, int(b), name) for b in places]
        tree = max([t for t in options if may_become_allowed(t, taxa, positive, negative)] or options, key=data.lnl)
    best = data.optimise_branches(tree, passes=2)
    for _ in range(rounds):
        options = [t for t in interchanges(tree) if allowed(t, taxa, positive, negative)]
        scored = sorted(((data.lnl(t), i) for i, t in enumerate(options)), reverse=True)
        gained = False
        for _, i in scored:
            lnl = data.optimise_branches(options[i], passes=2)
            if lnl > best + 0.01:
                tree, best, gained = options[i], lnl, True
                break
        if not gained:
            break
    return tree, data.optimise_branches(tree, passes=5)


def pruned(tree: Tree, node: int) -> tuple[Tree, Tree]:
    """The rest of a binary tree, its branch above the cut joined to one, and the subtree that was below ``node``."""
    kids = tree.children()
    inside, todo = [], [node]
    while todo:
        v = todo.pop()
        inside.append(v)
        todo += kids[v]
    at = {v: i for i, v in enumerate(inside)}
    sub = Tree([at[tree.parent[v]] if v != node else -1 for v in inside], [tree.label[v] for v in inside], [tree.length[v] for v in inside])
    parent, label, length = list(tree.parent), list(tree.label), list(tree.length)
    up = parent[node]
    left = [k for k in kids[up] if k != node]
    gone = set(inside)
    if len(left) == 1:  # its parent has nothing to part any more
        (other,) = left
        if parent[up] >= 0:
            parent[other], length[other] = parent[up], (length[other] or START) + (length[up] or START)
            gone.add(up)
        else:
            parent[other] = -1
            gone.add(up)
    elif len(left) == 2 and parent[up] < 0:  # a root of three has to keep three
        a = next((x for x in left if kids[x]), None)
        if a is not None:
            b = left[0] if left[1] == a else left[1]
            length[b] = (length[b] or START) + (length[a] or START)
            for k in kids[a]:
                parent[k] = up
            gone.add(a)
    keep = [v for v in range(len(parent)) if v not in gone]
    to = {v: i for i, v in enumerate(keep)}
    return renumbered(Tree([to[parent[v]] if parent[v] >= 0 else -1 for v in keep], [label[v] for v in keep], [length[v] for v in keep])), sub


def grafted(tree: Tree, branch: int, sub: Tree) -> Tree:
    """A subtree in the middle of the branch above node ``branch``."""
    out = copy.deepcopy(tree)
    mid = out.add(out.parent[branch])
    half = max((out.length[branch] or START) / 2, START / 10)
    out.length[mid], out.length[branch], out.parent[branch] = half, half, mid
    base = len(out.parent)
    for v in range(len(sub.parent)):
        out.parent.append(base + sub.parent[v] if sub.parent[v] >= 0 else mid)
        out.label.append(sub.label[v])
        out.length.append(sub.length[v])
    return renumbered(out)


def branch_distances(tree: Tree, start: int) -> dict[int, int]:
    """Edges from a node to all others."""
    kids, seen, now = tree.children(), {start: 0}, [start]
    while now:
        nxt = []
        for v in now:
            for w in [*kids[v], *([tree.parent[v]] if tree.parent[v] >= 0 else [])]:
                if w not in seen:
                    seen[w] = seen[v] + 1
                    nxt.append(w)
        now = nxt
    return seen


def regrafts(tree: Tree, reach: int = 6) -> list[Tree]:
    """All different trees that come of cutting one subtree and attaching it elsewhere, at most ``reach`` edges away."""
    taxa = sorted(x for x in tree.label if x)
    found, seen = [], {splits(tree, taxa)}
    for v in range(1, len(tree.parent)):
        rest, sub = pruned(tree, v)
        if len(rest.tips()) < 3:
            continue
        # Where the cut was: the nearest branch that is left, told by the taxa next to it.
        side = {x for x in _below(tree, tree.parent[v]) if x} - {x for x in sub.label if x}
        home = next((w for w in range(1, len(rest.parent)) if set(_below(rest, w)) == side), 0)
        far = branch_distances(rest, home)
        for w in range(1, len(rest.parent)):
            if far[w] <= reach:
                new = grafted(rest, w, sub)
                key = splits(new, taxa)
                if key not in seen:
                    seen.add(key)
                    found.append(new)
    return found


def _below(tree: Tree, node: int) -> list[str]:
    kids, out, todo = tree.children(), [], [node]
    while todo:
        v = todo.pop()
        todo += kids[v]
        if not kids[v]:
            out.append(tree.label[v])
    return out


def random_tree(taxa: list[str], seed: int, positive: frozenset[int] = frozenset()) -> Tree:
    """Taxa in random order, each on a random branch that the positive constraints allow."""
    rng = np.random.default_rng(seed)
    order = [taxa[i] for i in rng.permutation(len(taxa))]
    tree = star_of_three(order[:3])
    for name in order[3:]:
        for b in rng.permutation(np.arange(1, len(tree.parent))):
            new = attach(tree, int(b), name)
            if may_become_allowed(new, taxa, positive, frozenset()):
                break
        tree = new
    return tree


def rooted_at(tree: Tree, outgroup: set[str]) -> Tree:
    """The same tree with its root beside the outgroup: where the branch to it leaves, if it is a group; else at the
    branch of its first taxon."""
    target = next((v for v in range(1, len(tree.parent)) if set(_below(tree, v)) in (outgroup, set(filter(None, tree.label)) - outgroup)), None)
    if target is None:
        target = next(v for v, x in enumerate(tree.label) if x in outgroup)
    new_root = tree.parent[target]
    parent, length = list(tree.parent), list(tree.length)
    v, above, t = new_root, -1, None
    while v >= 0:
        nxt, own = tree.parent[v], tree.length[v]
        parent[v], length[v] = above, t
        v, above, t = nxt, v, own
    return renumbered(Tree(parent, list(tree.label), length))


def collapsed(tree: Tree, shortest: float = 3e-8) -> Tree:
    """Without inner branches that are no longer than ``shortest``."""
    kids, parent = tree.children(), list(tree.parent)
    gone = {v for v in range(1, len(parent)) if kids[v] and (tree.length[v] or 0.0) <= shortest}
    for v in range(1, len(parent)):
        while parent[v] in gone:
            parent[v] = parent[parent[v]]
    keep = [v for v in range(len(parent)) if v not in gone]
    at = {v: i for i, v in enumerate(keep)}
    return renumbered(Tree([at[parent[v]] if parent[v] >= 0 else -1 for v in keep], [tree.label[v] for v in keep], [tree.length[v] for v in keep]))


def scaled(tree: Tree, factor: float) -> Tree:
    return Tree(list(tree.parent), list(tree.label), [None if t is None else t * factor for t in tree.length])


def with_lengths_mutated(tree: Tree, rng: np.random.Generator, shape: float = 1000.0, share: float = 0.2) -> Tree:
    """Some branches times gamma variates of mean 1."""
    hit = rng.random(len(tree.length)) < share
    return Tree(list(tree.parent), list(tree.label), [t if t is None or not h else max(1e-8, t * float(rng.gamma(shape, 1 / shape))) for t, h in zip(tree.length, hit)])


def recombined(a: Tree, b: Tree, rng: np.random.Generator) -> Tree:
    """A tree like ``a``, in which a group of taxa has the subtree that it has in ``b``. Groups are those both have; without
    any but single taxa and all, a copy of ``a``."""
    of = lambda t: {frozenset(_below(t, v)): v for v in range(1, len(t.parent)) if len(_below(t, v)) > 2}
    mine, theirs = of(a), of(b)
    common = sorted((k for k in mine if k in theirs), key=sorted)
    if not common:
        return copy.deepcopy(a)
    group = common[int(rng.integers(len(common)))]
    _, sub = pruned(b, theirs[group])
    inside, todo, kids = set(), [mine[group]], a.children()
    while todo:
        v = todo.pop()
        inside.add(v)
        todo += kids[v]
    keep = [v for v in range(len(a.parent)) if v not in inside]
    at = {v: i for i, v in enumerate(keep)}
    out = Tree([at[a.parent[v]] if a.parent[v] >= 0 else -1 for v in keep], [a.label[v] for v in keep], [a.length[v] for v in keep])
    base = len(out.parent)
    for v in range(len(sub.parent)):
        out.parent.append(base + sub.parent[v] if sub.parent[v] >= 0 else at[a.parent[mine[group]]])
        out.label.append(sub.label[v])
        out.length.append(sub.length[v] if v else a.length[mine[group]])
    return renumbered(out)


def swap_to_completion(data: Likelihood, tree: Tree, *, reach: int = 6, gain: float = 0.01, allow=None) -> tuple[Tree, float]:
    """Cut and attach until no neighbour within ``reach`` gains: all neighbours are scored, and then tried from the best on."""
    best = data.optimise_branches(tree, passes=2)
    while True:
        options = [t for t in regrafts(tree, reach) if allow is None or allow(t)]
        for _, i in sorted(((data.lnl(t), -i) for i, t in enumerate(options)), reverse=True):
            new = options[-i]
            lnl = data.optimise_branches(new, passes=2)
            if lnl > best + gain:
                tree, best = new, lnl
                break
        else:
            return tree, data.optimise_branches(tree, passes=5)
