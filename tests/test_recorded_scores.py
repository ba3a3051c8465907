"""Likelihoods against scores that sample files record, where a folder of such files is given in CLADEFRAME_SAMPLES."""

import os
from pathlib import Path

import numpy as np
import pytest

from cladeframe.kernels.likelihood import Likelihood
from cladeframe.kernels.models import gtr
from cladeframe.sources.alignment import read_blocks
from cladeframe.sources.config import recorded
from cladeframe.sources.newick import parse_newick

FOLDER = os.environ.get("CLADEFRAME_SAMPLES", "")
pytestmark = pytest.mark.skipif(not FOLDER, reason="no folder of sample files is given")


def _translated(text):
    (block,) = read_blocks(text)
    return block.trees


def test_nucleotide_scores():
    """Trees with gamma shape and invariant sites, over each nucleotide matrix of the same taxa, weights applied."""
    matrices = [b for f in Path(FOLDER).glob("*.nex") for b in read_blocks(f.read_text())]
    matrices = [m for m in matrices if m.datatype == "dna" and m.rows and not m.partitions]
    checked = 0
    for f in Path(FOLDER).glob("*.start"):
        text = f.read_text()
        for one in recorded(text):
            p = one["parameters"].get("M1", {})
            if one["score"] is None or not {"r", "e", "a", "p"} <= set(p) or len(p["r"]) != 6:
                continue
            model = lambda n: gtr(p["r"], p["e"], alpha=p["a"][0], n_classes=n, pinv=p["p"][0])
            tree = parse_newick(next(iter(_translated(text).values())))
            labels = {x for x in tree.label if x}
            found = []
            for m in matrices:
                if set(m.rows) == labels and m.n_columns > 1000:
                    columns = m.columns()
                    weights = np.array([m.weights.get(i, 1) for i in columns])
                    found += [Likelihood(np.array(m.masks(columns)), list(m.rows), weights, model(n)).lnl(tree) for n in (4, 5)]
            if found:
                assert min(abs(x - one["score"]) for x in found) < 1e-3, (f.name, found, one["score"])
                checked += 1
    assert checked
