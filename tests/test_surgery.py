"""Tree surgery, mixtures, one-dimensional maxima, partitioned data."""

import numpy as np
import pytest

from cladeframe.kernels import models, optimise, search
from cladeframe.kernels.likelihood import Likelihood, optimise_together, total_lnl
from cladeframe.sources.newick import parse_newick, write_newick

TAXA = list("abcdefg")
TREE = "((a:.1,b:.2):.05,((c:.1,d:.1):.1,e:.3):.2,(f:.1,g:.2):.1);"


def data(n=60, k=4, seed=1, **more):
    rng = np.random.default_rng(seed)
    m = 1 << rng.integers(0, k, (len(TAXA), n))
    m[:, : n // 2] = m[:1, : n // 2]
    return Likelihood(m, TAXA, np.ones(n), more.pop("model", models.jukes_cantor(k)), **more)


def test_neighbours():
    tree = parse_newick(TREE)
    near, far = search.regrafts(tree, 1), search.regrafts(tree, 99)
    mine = search.splits(tree, TAXA)
    sets = {search.splits(t, TAXA) for t in far}
    # A binary tree of n taxa has 2 (n - 3) (2 n - 7) neighbours by cutting and attaching.
    assert len(sets) == len(far) == 2 * 4 * 7 and mine not in sets
    assert {search.splits(t, TAXA) for t in search.interchanges(tree)} <= sets and len(near) < len(far)
    assert all(sorted(filter(None, t.label)) == TAXA and len(t.parent) == len(tree.parent) for t in far)


def test_surgery_keeps_taxa_and_lnl():
    tree, d = parse_newick(TREE), data()
    turned = search.rooted_at(tree, {"d"})
    assert turned.label[[k for k in turned.children()[0] if not turned.children()[k]][0]] in ("c", "d")
    assert search.splits(turned, TAXA) == search.splits(tree, TAXA) and d.lnl(turned) == pytest.approx(d.lnl(tree), abs=1e-8)
    assert sum(t or 0 for t in turned.length) == pytest.approx(sum(t or 0 for t in tree.length))
    short = parse_newick(TREE.replace(":.05", ":1e-8"))
    assert len(search.collapsed(short).parent) == len(tree.parent) - 1 and d.lnl(search.collapsed(short)) == pytest.approx(d.lnl(short), abs=1e-3)
    other = parse_newick("((a:.1,b:.2):.05,((c:.1,e:.1):.1,d:.3):.2,(f:.1,g:.2):.1);")
    mixed = search.recombined(tree, other, np.random.default_rng(0))
    assert search.splits(mixed, TAXA) in (search.splits(other, TAXA), search.splits(tree, TAXA)) and sorted(filter(None, mixed.label)) == TAXA
    assert search.splits(search.random_tree(TAXA, 3, frozenset([0b0000011])), TAXA) >= {0b0000011}
    assert sum(filter(None, search.scaled(tree, 2).length)) == pytest.approx(2 * sum(filter(None, tree.length)))


def test_derivatives_and_sweeps():
    for more in ({"model": models.gtr([1, 2, 1, 1, 3, 1], [0.3, 0.2, 0.2, 0.3], alpha=0.7, pinv=0.2)}, {"model": models.mk(2), "k": 2, "conditioned": np.array([[1, 2]] * 7)}):
        k = more.pop("k", 4)
        d, tree = data(k=k, **more), parse_newick(TREE)
        kids, parts = tree.children(), [None] * len(tree.parent)
        for v in reversed(range(len(tree.parent))):
            d._down(tree, kids, parts, v)
        v = kids[0][0]
        ones = (np.broadcast_to(d.model.freqs, (len(d.model.rates), len(d.constant), d.states)), np.zeros(len(d.constant)))
        above = d._combined([ones, *[(np.einsum("cij,csj->csi", d._p(tree.length[x]), parts[x][0]), parts[x][1]) for x in kids[0][1:]]])
        f = lambda t: d.curve(above, parts[v], t)
        assert f(tree.length[v])[0] == pytest.approx(d.lnl(tree), abs=1e-8)
        h = 1e-4
        assert f(0.1)[1] == pytest.approx((f(0.1 + h)[0] - f(0.1 - h)[0]) / (2 * h), rel=1e-4)
        assert f(0.1)[2] == pytest.approx((f(0.1 + h)[1] - f(0.1 - h)[1]) / (2 * h), rel=1e-3)
        best = d.optimise_branches(tree, passes=30, precision=1e-7)
        for v in range(1, len(tree.parent)):
            old = tree.length[v]
            for factor in (0.9, 1.1):
                tree.length[v] = old * factor
                assert d.lnl(tree) <= best + 1e-4
            tree.length[v] = old


def test_partitioned_data():
    parts, tree = [data(seed=1), data(seed=2, rate=2.0)], parse_newick(TREE)
    assert parts[1].lnl(tree) == pytest.approx(data(seed=2).lnl(search.scaled(tree, 2.0)), abs=1e-9)
    start = total_lnl(parts, tree)
    assert optimise_together(parts, tree) > start
    rates, best = optimise.optimise_rates(lambda r: sum(data(seed=i + 1, rate=x).lnl(tree) for i, x in enumerate(r)), [60, 60], [1.0, 1.0])
    assert sum(rates) == pytest.approx(2.0) and best >= total_lnl([data(seed=1), data(seed=2)], tree)


def test_mixture_and_matrices():
    code = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
    f = np.full(61, 1 / 61)
    x = np.ones((4, 4))
    one = models.codon_model(x, f, code, 0.5)
    mix = models.codon_mixture(x, f, code, [0.5, 0.5], [0.3, 0.7])
    assert np.allclose(mix.transition(0.3)[0], one.transition(0.3)[0]) and mix.weights.sum() == pytest.approx(1)
    two = models.codon_mixture(x, f, code, [0.1, 2.0], [0.5, 0.5])
    rate = sum(w * -(f * np.diagonal((p - np.eye(61)) / 1e-6)).sum() for w, p in zip(two.weights, two.transition(1e-6)))
    assert rate == pytest.approx(1, rel=1e-3)
    flex = models.flexible(models.jukes_cantor(), [1, 2, 5], [1, 1, 2])
    assert flex.weights @ flex.rates == pytest.approx(1)
    text = " ".join(str(i + 1) for i in range(190)) + " " + " ".join(["0.05"] * 20)
    ex, fr = models.exchange_from_text(text)
    assert ex[1, 0] == 1 and ex[19, 18] == 190 and (ex == ex.T).all() and fr.sum() == pytest.approx(1)
    assert np.allclose(models.amino_acid_model(ex, fr).transition(0.2)[0].sum(1), 1)
    assert np.allclose(models.classed([0, 1, 0, 0, 1, 0], {0: 1.0, 1: 4.0}, [0.25] * 4).q, models.hky(4.0, [0.25] * 4).q)


def test_maxima():
    f = lambda x: -((x - 1.3) ** 2) * (1 + 0.1 * x)
    assert optimise.brent(f, -2, 4)[0] == pytest.approx(1.3, abs=1e-4)
    a, b, c = optimise.bracket(f, 0.0, 0.1, -5, 5)
    assert min(a, c) < 1.3 < max(a, c) and f(b) >= max(f(a), f(c))
    assert sum(optimise.mutated([1.0, 2.0, 3.0], np.random.default_rng(1))) == pytest.approx(6)


def test_swaps_find_the_tree_that_made_the_data():
    tree, rng = parse_newick(TREE), np.random.default_rng(4)
    m = models.jukes_cantor()
    n, states = 400, {}
    for v in range(len(tree.parent)):
        if v == 0:
            states[v] = rng.integers(0, 4, n)
        else:
            p = m.transition(tree.length[v])[0]
            states[v] = np.array([rng.choice(4, p=p[x] / p[x].sum()) for x in states[tree.parent[v]]])
    masks = np.array([1 << states[tree.label.index(t)] for t in TAXA])
    found, lnl = search.swap_to_completion(Likelihood(masks, TAXA, np.ones(n), m), search.random_tree(TAXA, 8))
    assert search.splits(found, TAXA) == search.splits(tree, TAXA) and write_newick(found)
