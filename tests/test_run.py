"""From a configuration to trees, checkpoints and site likelihoods."""

import json

import numpy as np
import pytest

from cladeframe.kernels import evolve, models
from cladeframe.kernels.likelihood import Likelihood
from cladeframe.kernels.search import splits
from cladeframe.run import Run, subsets_of
from cladeframe.sources.alignment import read_blocks
from cladeframe.sources.newick import parse_newick
from cladeframe.sources.writers import nexus_matrix

TAXA = list("abcdef")
TREE = "((a:.1,b:.1):.1,(c:.1,d:.1):.1,(e:.1,f:.1):.1);"


def simulated(n=300, seed=3):
    tree, m, rng = parse_newick(TREE), models.jukes_cantor(), np.random.default_rng(seed)
    at = {0: rng.integers(0, 4, n)}
    for v in range(1, len(tree.parent)):
        p = m.transition(tree.length[v])[0]
        at[v] = np.array([rng.choice(4, p=p[x] / p[x].sum()) for x in at[tree.parent[v]]])
    return {t: "".join("ACGT"[x] for x in at[tree.label.index(t)]) for t in TAXA}


def conf(folder, **more):
    general = {"datafname": "m.nex", "ofprefix": "out", "randseed": 5, "ratematrix": "1rate", "ratehetmodel": "none", "numratecats": 1, "invariantsites": "none", "statefrequencies": "equal", "genthreshfortopoterm": 10, "searchreps": 2, "writecheckpoints": 1, "outputsitelikelihoods": 1, "streefname": "random", "outgroup": "1"} | more.pop("general", {})
    master = {"nindivs": 3, "intervallength": 5, "intervalstostore": 2} | more.pop("master", {})
    (folder / "m.nex").write_text(nexus_matrix(simulated()))
    (folder / "run.conf").write_text("[general]\n" + "".join(f"{k} = {v}\n" for k, v in general.items()) + "[master]\n" + "".join(f"{k} = {v}\n" for k, v in master.items()))
    return str(folder / "run.conf")


def test_search_finds_the_tree(spark, tmp_path):
    run = Run(spark, conf(tmp_path))
    got = {r["rep"]: r for r in run.go(stop_after=60).collect()}
    want = splits(parse_newick(TREE), TAXA)
    best = max(got.values(), key=lambda r: r["lnl"])
    assert set(got) == {1, 2} and splits(parse_newick(best["newick"]), TAXA) == want
    sites = [x.split("\t") for x in (tmp_path / "out.sitelikes.log").read_text().splitlines()[1:]]
    assert len(sites) == 300 and sum(float(x[2]) for x in sites) == pytest.approx(max(r["lnl"] for r in got.values()), abs=0.01)
    assert (tmp_path / "out.best.tre").exists() and len(read_blocks((tmp_path / "out.best.all.tre").read_text())[0].trees) == 2
    saved = json.loads((tmp_path / "out.check.json").read_text())
    again = run.resume(stop_after=5)
    assert {r[0] for r in again} == {1, 2} and all(r[4] == json.loads(saved["states"][str(r[0])])["generation"] + 5 or r[3] >= got[r[0]]["lnl"] - 0.1 for r in again)


def test_bootstrap_replicates_differ(spark, tmp_path):
    got = Run(spark, conf(tmp_path, master={"bootstrapreps": 3})).go(stop_after=10).collect()
    assert len(got) == 3 and len({round(r["lnl"], 3) for r in got}) == 3 and (tmp_path / "out.boot.tre").exists()


def test_a_search_goes_on_where_it_stopped():
    rows = simulated(60)
    d = Likelihood(np.array([[1 << "ACGT".index(x) for x in rows[t]] for t in TAXA]), TAXA, np.ones(60), models.jukes_cantor())
    s = evolve.Settings(size=3, interval=4, stored=2, topology_patience=1000)
    call = lambda state, n: evolve.evolve(d.lnl, lambda t: d.optimise_branches(t, passes=1), [parse_newick(TREE)], s, state=state, stop_after=n)
    whole, half = call(None, 8), call(None, 4)
    half.trees = list(half.trees)
    rest = call(evolve.State(**json.loads(json.dumps(half.as_dict()))), 4)
    assert rest.generation == whole.generation == 8 and max(rest.scores) == pytest.approx(max(whole.scores), abs=0.05)
    assert evolve.probabilities([[1, 0, 0, 0, 0]], [[100.0, 0, 0, 0, 0]]).min() >= evolve.FLOOR / 2


def test_standard_characters_are_split_by_states():
    text = '#NEXUS\nbegin data; dimensions nchar=4; format datatype=standard symbols="012" missing=?;\nmatrix a 010?\nb 0215\nc 1?2?\nd 1(01)2?;\nend;'
    subs = subsets_of(read_blocks(text.replace("5", "?"))[0])
    assert [(s.n_states, s.masks.shape[1]) for s in subs] == [(2, 1), (3, 2)]
    two = subs[0]
    assert sorted(two.masks[:, 0].tolist()) == [1, 1, 2, 2] and sum(map(len, (p for s in subs for p in s.columns))) == 3


def test_bad_configurations_do_not_start(spark, tmp_path):
    with pytest.raises(ValueError):
        Run(spark, conf(tmp_path, general={"datatype": "what"}))
