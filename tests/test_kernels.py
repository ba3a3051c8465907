import copy
from itertools import product

import numpy as np
import pytest

from cladeframe.kernels.likelihood import Likelihood
from cladeframe.kernels.models import discrete_gamma, gamma_p, gamma_quantile, gtr, jukes_cantor, mk
from cladeframe.kernels.search import interchanges, search, splits
from cladeframe.sources.newick import parse_newick

TREE = "(a:0.1,b:0.2,(c:0.15,d:0.3):0.05);"
TAXA = list("abcd")


def test_gamma():
    assert gamma_p(1, 2) == pytest.approx(1 - np.exp(-2)) and gamma_quantile(0.5, 1) == pytest.approx(np.log(2))
    assert discrete_gamma(0.5, 4) == pytest.approx([0.03338775, 0.25191592, 0.82026848, 2.89442785]) and discrete_gamma(2, 5).mean() == pytest.approx(1)


@pytest.mark.parametrize("model", [jukes_cantor(), gtr([1, 3, 0.5, 1, 4, 1], [0.1, 0.2, 0.3, 0.4], alpha=0.7, pinv=0.2), mk(3), mk(4, ordered=True)])
def test_transitions(model):
    p = model.transition(0.3)
    assert p.sum(2) == pytest.approx(np.ones(p.shape[:2])) and model.transition(0)[0] == pytest.approx(np.eye(len(model.freqs)))
    h = 1e-5
    assert (model.transition(0.3 + h) - model.transition(0.3 - h)) / (2 * h) == pytest.approx(model.transition(0.3, 1), abs=1e-7)
    assert model.freqs @ p[0] == pytest.approx(model.freqs)


def brute(model, tree, masks):
    """Sum over all states of all nodes."""
    kids, out = tree.children(), 0.0
    inner = [v for v, k in enumerate(kids) if k]
    for rate in range(len(model.rates)):
        p = [model.transition(x)[rate] if x is not None else None for x in tree.length]
        for states in product(range(4), repeat=len(inner)):
            at, f = dict(zip(inner, states)), model.freqs[states[0]] * model.weights[rate]
            for v in range(1, len(kids)):
                up = at[tree.parent[v]]
                f *= p[v][up, at[v]] if v in at else sum(p[v][up, s] for s in range(4) if masks[TAXA.index(tree.label[v])] >> s & 1)
            out += f
    return out + model.pinv * sum(model.freqs[s] for s in range(4) if all(m >> s & 1 for m in masks))


def test_likelihood_is_the_sum_over_all_histories():
    model, tree = gtr([1, 3, 0.5, 1, 4, 1], [0.1, 0.2, 0.3, 0.4], alpha=0.7, n_classes=3, pinv=0.2), parse_newick(TREE)
    masks = np.array([[1, 1, 8, 5], [1, 2, 8, 15], [1, 4, 2, 1], [1, 8, 15, 15]])
    got = Likelihood(masks, TAXA, np.ones(4), model).site_lnl(tree)
    assert np.exp(got) == pytest.approx([brute(model, tree, masks[:, i]) for i in range(4)])


def test_all_patterns_sum_to_one_and_rooting_does_not_matter():
    masks = np.array(list(product((1, 2, 4, 8), repeat=4))).T
    model = gtr([1, 3, 0.5, 1, 4, 1], [0.1, 0.2, 0.3, 0.4], alpha=0.7)
    data = Likelihood(masks, TAXA, np.ones(256), model)
    a, b = data.site_lnl(parse_newick(TREE)), data.site_lnl(parse_newick("(c:0.15,d:0.3,(a:0.1,b:0.2):0.05);"))
    assert np.exp(a).sum() == pytest.approx(1) and a == pytest.approx(b)
    assert data.ancestral(parse_newick(TREE), 3).sum(1) == pytest.approx(np.ones(256))


def test_variable_only_patterns_sum_to_one():
    masks = np.array([x for x in product((1, 2), repeat=4) if len(set(x)) > 1]).T
    data = Likelihood(masks, TAXA, np.ones(masks.shape[1]), mk(2), np.array([[1, 2]] * 4))
    assert np.exp(data.site_lnl(parse_newick(TREE))).sum() == pytest.approx(1)


def simulated(n=600):
    rng, model, tree = np.random.default_rng(4), jukes_cantor(), parse_newick("((a:0.1,b:0.1):0.1,c:0.2,(d:0.1,(e:0.1,f:0.2):0.1):0.1);")
    states = np.zeros((len(tree.parent), n), int)
    for v in range(len(tree.parent)):
        p = model.transition(tree.length[v] or 0)[0]
        states[v] = rng.integers(0, 4, n) if v == 0 else [rng.choice(4, p=p[s] / p[s].sum()) for s in states[tree.parent[v]]]
    return tree, np.array([1 << states[tree.label.index(t)] for t in "abcdef"])


def test_search_finds_the_tree():
    tree, masks = simulated()
    data = Likelihood(masks, list("abcdef"), np.ones(masks.shape[1]), jukes_cantor())
    found, lnl = search(data, list("abcdef"), 3)
    assert splits(found, list("abcdef")) == splits(tree, list("abcdef"))
    start = copy.deepcopy(tree)
    assert lnl == pytest.approx(data.optimise_branches(start), abs=0.05) and len({splits(t, list('abcdef')) for t in interchanges(tree)}) == 6 == len(interchanges(tree))
    other, _ = search(data, list("abcdef"), 3, negative=frozenset([3]))
    assert 3 not in splits(other, list("abcdef"))


def test_search_tries_all_interchanges():
    taxa = list("abcdef")

    class Misleading:
        better = None

        def lnl(self, tree):
            return -1.0 if splits(tree, taxa) == self.better else 0.0

        def optimise_branches(self, tree, passes):
            return -self.lnl(tree)

    data = Misleading()
    start, _ = search(data, taxa, 3, rounds=0)
    for neighbour in interchanges(start):
        data.better = splits(neighbour, taxa)
        found, lnl = search(data, taxa, 3)
        assert splits(found, taxa) == data.better and lnl == 1
