"""A session of text commands over a run: counts, weights, constraints, trees, searches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .kernels.likelihood import optimise_together, total_lnl
from .kernels.search import allowed, interchanges, search, swap_to_completion
from .run import Run
from .sources.alignment import column_ranges
from .sources.config import parse_constraints
from .sources.newick import Tree, parse_newick, write_newick


@dataclass
class Commands:
    """Each command is a line; what it has to say comes back as text. An unknown command raises.

    run n; model; tree newick; treenum; nbest n; optplausible x; sitelikes; patterncounts; setpatterncounts counts;
    setcharintwts weights of all columns; search seed; swap reach; stepadd seed; clear; posconstraint tree;
    negconstraint tree; clearconstraints; quit.
    """

    run: Run
    kept: list[tuple[float, str]] = field(default_factory=list)
    most: int = 10
    positive: set[int] = field(default_factory=set)
    negative: set[int] = field(default_factory=set)
    ended: bool = False

    def __post_init__(self) -> None:
        self.counts = [s.counts.astype(float).copy() for s in self.run.subsets]

    def __call__(self, line: str) -> str:
        word, _, rest = line.strip().rstrip(";").partition(" ")
        do = getattr(self, f"_{word.lower()}", None)
        if do is None:
            raise ValueError(f"no command {word}")
        return do(rest.strip())

    def _data(self):
        return self.run.data(self.counts)

    def _keep(self, tree: Tree, lnl: float) -> str:
        """The best trees, at most so many, each once."""
        text = write_newick(tree)
        self.kept = sorted({t: x for x, t in [*self.kept, (lnl, text)]}.items(), key=lambda kv: -kv[1])[: self.most]
        self.kept = [(x, t) for t, x in self.kept]
        return f"{lnl:.6f}"

    def _fits(self, tree: Tree) -> bool:
        return allowed(tree, self.run.taxa, frozenset(self.positive), frozenset(self.negative))

    def _tree(self, rest: str) -> str:
        tree = parse_newick(rest if rest.endswith(";") else rest + ";", {str(i + 1): t for i, t in enumerate(self.run.taxa)})
        return self._keep(tree, optimise_together(self._data(), tree, passes=5))

    def _nbest(self, rest: str) -> str:
        self.most = int(rest or self.most)
        self.kept = self.kept[: self.most]
        return "\n".join(f"{x:.6f}\t{t}" for x, t in self.kept)

    def _treenum(self, rest: str) -> str:
        return str(len(self.kept))

    def _optplausible(self, rest: str) -> str:
        """Optimise again the kept trees that are within so much of the best."""
        within = float(rest or 2.0)
        near = [t for x, t in self.kept if x >= self.kept[0][0] - within]
        for t in near:
            self._tree(t)
        return str(len(near))

    def _model(self, rest: str) -> str:
        return "\n".join(f"{s.name}: {len(m.freqs)} states, frequencies {' '.join(f'{f:.5f}' for f in m.freqs[:6])}" for s, m in zip(self.run.subsets, self.run.models))

    def _patterncounts(self, rest: str) -> str:
        return " ".join(f"{x:g}" for c in self.counts for x in c)

    def _setpatterncounts(self, rest: str) -> str:
        new = [float(x) for x in rest.split()]
        if len(new) != sum(map(len, self.counts)):
            raise ValueError("another number of patterns")
        at = 0
        for i, c in enumerate(self.counts):
            self.counts[i] = np.array(new[at : at + len(c)])
            at += len(c)
        return f"{sum(new):g}"

    def _setcharintwts(self, rest: str) -> str:
        """Weights of all columns; counts change by the differences only."""
        new = [int(x) for x in rest.split()]
        changed = 0
        for i, s in enumerate(self.run.subsets):
            for p, columns in enumerate(s.columns):
                now = sum(new[c - 1] for c in columns)
                changed += now != self.counts[i][p]
                self.counts[i][p] = now
        return f"{changed} patterns changed"

    def _sitelikes(self, rest: str) -> str:
        tree = parse_newick(self.kept[0][1])
        return " ".join(f"{x:.6f}" for d in self._data() for x in d.site_lnl(tree))

    def _search(self, rest: str) -> str:
        data = self._data()
        tree, _ = search(data[0], self.run.taxa, int(rest or 1), positive=frozenset(self.positive), negative=frozenset(self.negative))
        return self._keep(tree, optimise_together(data, tree, passes=5))

    def _stepadd(self, rest: str) -> str:
        data = self._data()
        tree, _ = search(data[0], self.run.taxa, int(rest or 1), rounds=0, positive=frozenset(self.positive))
        return self._keep(tree, total_lnl(data, tree))

    def _swap(self, rest: str) -> str:
        tree, lnl = swap_to_completion(self._data()[0], parse_newick(self.kept[0][1]), reach=int(rest or 6), allow=self._fits)
        return self._keep(tree, lnl)

    def _nni(self, rest: str) -> str:
        """Scores of all neighbours of the best tree, best first."""
        data = self._data()
        return " ".join(f"{x:.4f}" for x in sorted((total_lnl(data, t) for t in interchanges(parse_newick(self.kept[0][1]))), reverse=True))

    def _run(self, rest: str) -> str:
        _, _, newick, lnl, _, _ = self.run.one_replicate(1, "search", 1, int(rest or 50), None)
        return self._keep(parse_newick(newick), lnl)

    def _posconstraint(self, rest: str) -> str:
        self.positive |= {x.split for x in parse_constraints("+" + rest, self.run.taxa)}
        return str(len(self.positive))

    def _negconstraint(self, rest: str) -> str:
        self.negative |= {x.split for x in parse_constraints("-" + rest, self.run.taxa)}
        return str(len(self.negative))

    def _clearconstraints(self, rest: str) -> str:
        self.positive.clear()
        self.negative.clear()
        return "0"

    def _show(self, rest: str) -> str:
        """How many columns of a list take part."""
        taking = {c for s in self.run.subsets for places in s.columns for c in places}
        return str(len([c for c in column_ranges(rest or "1-.", max(taking)) if c in taking]))

    def _clear(self, rest: str) -> str:
        self.kept.clear()
        return "0"

    def _quit(self, rest: str) -> str:
        self.ended = True
        return ""
