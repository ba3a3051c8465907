"""Text commands over a run, and variates."""

import pytest

from cladeframe.commands import Commands
from cladeframe.functions import variates
from cladeframe.run import Run
from test_run import TREE, conf


def test_session(tmp_path):
    do = Commands(Run(None, conf(tmp_path)))
    first = float(do(f"tree {TREE}"))
    assert do("treenum") == "1" and float(do("stepadd 3")) <= first + 1e-3 and float(do("swap 6")) == pytest.approx(first, abs=0.05)
    sites = [float(x) for x in do("sitelikes").split()]
    counts = [float(x) for x in do("patterncounts").split()]
    assert sum(counts) == 300 and sum(a * b for a, b in zip(sites, counts)) == pytest.approx(first, abs=0.05)
    assert do("show 1-10") == "10" and all(float(x) <= first + 0.01 for x in do("nni").split())
    do("setcharintwts " + " ".join(["2"] * 300))
    assert sum(map(float, do("patterncounts").split())) == 600 and float(do(f"tree {TREE}")) == pytest.approx(2 * first, abs=0.1)
    assert do("nbest 1").count("\n") == 0 and do("posconstraint ((a,c),b,d,e,f)") == "1" and do("clearconstraints") == "0"
    assert do("clear") == "0" and do("treenum") == "0" and do("quit") == "" and do.ended
    with pytest.raises(ValueError):
        do("dance")


def test_variates():
    assert variates.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert variates.chi_square_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5)
    assert sum(variates.dirichlet([0.2, 0.5, 0.9], [1, 2, 3])) == pytest.approx(1)
    assert [variates.binomial(u, 4, 0.5) for u in (0.01, 0.5, 0.99)] == [0, 2, 4] and variates.binomial(0.3, 5, 1) == 5
    assert variates.exponential(0.5, 2) == pytest.approx(0.346574, abs=1e-6) and variates.chunk_patterns(20, 4, 4, 1 << 20) == 409
