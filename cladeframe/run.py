"""From a configuration file to trees: ``python -m cladeframe.run run.conf``.

Each search replicate, and each bootstrap replicate, is a row of a DataFrame and a task of its own; its data are the
collapsed patterns, which are broadcast after their size is checked. Results are tables, and text files beside them.
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .kernels.evolve import Settings, State, evolve
from .kernels.likelihood import Likelihood, optimise_together, total_lnl
from .kernels.models import amino_acid_model, classed, gtr, hky, mk
from .kernels.search import allowed, collapsed, random_tree, rooted_at, search
from .sources.alignment import Alignment, read_blocks
from .sources.config import RunConfig, parse_constraints, rate_classes
from .sources.newick import parse_newick, write_newick
from .sources.writers import nexus_trees

#: Patterns of more bytes than this are not broadcast.
MOST_BYTES = 512 << 20


@dataclass
class Subset:
    """Collapsed patterns of one subset of columns: masks (taxon, pattern), how often each stands, its columns."""

    name: str
    masks: np.ndarray
    counts: np.ndarray
    columns: list[list[int]]
    kind: str
    n_states: int


def subsets_of(block: Alignment, kind: str | None = None) -> list[Subset]:
    """A matrix as subsets of collapsed patterns. All-missing columns are dropped. Standard characters are split by their
    number of states, which says how many states their model has."""
    out = []
    for name, columns in block.subsets().items():
        masks = np.array(block.masks(columns), np.int64)
        full = block.full
        weights = np.array([block.weights.get(i, 1) for i in columns])
        keep = (masks != full).any(0) & (weights > 0)
        masks, weights, columns = masks[:, keep], weights[keep], [c for c, k in zip(columns, keep) if k]
        groups: dict[int, list[int]] = {}
        standard = block.datatype not in ("dna", "rna", "nucleotide", "protein", "aminoacid")
        for i in range(masks.shape[1]):
            seen = int(np.bitwise_or.reduce(np.where(masks[:, i] == full, 0, masks[:, i])))
            groups.setdefault(bin(seen).count("1") if standard else 0, []).append(i)
        for k, mine in sorted(groups.items()):
            if standard and k < 2:
                k = 2
            part = masks[:, mine]
            if standard:  # states are numbered from 0 within the subset
                part = np.stack([_packed(part[:, i], full) for i in range(part.shape[1])], 1)
            patterns, first, which = np.unique(part, axis=1, return_index=True, return_inverse=True)
            counts = np.bincount(which.ravel(), weights=weights[mine], minlength=patterns.shape[1])
            places = [[columns[mine[i]] for i in np.flatnonzero(which.ravel() == p)] for p in range(patterns.shape[1])]
            out.append(Subset(f"{name}.{k}" if standard else name, patterns, counts, places, kind or block.datatype, k or (20 if block.datatype in ("protein", "aminoacid") else 4)))
    return out


def _packed(column: np.ndarray, full: int) -> np.ndarray:
    states = [s for s in range(full.bit_length()) if any(m != full and m >> s & 1 for m in column.tolist())] or [0, 1]
    to = {s: i for i, s in enumerate(states)}
    whole = (1 << max(2, len(states))) - 1
    return np.array([whole if m == full else sum(1 << to[s] for s in states if m >> s & 1) for m in column.tolist()], np.int64)


def model_of(conf: RunConfig, section: str, subset: Subset):
    """The model that a section asks for. Estimated values start at what the data say, or at even ones."""
    rates, het = str(conf.get(section, "ratematrix", "6rate")).lower(), str(conf.get(section, "ratehetmodel", "gamma")).lower()
    if subset.kind.startswith(("standard", "binary")):
        return mk(subset.n_states, ordered="ordered" in subset.kind)
    n = int(conf.get(section, "numratecats", 4))
    gamma = {"alpha": 0.5 if het == "gamma" and n > 1 else None, "n_classes": n, "pinv": 0.1 if str(conf.get(section, "invariantsites", "estimate")).lower() == "estimate" else 0.0}
    bits = (subset.masks[:, :, None] >> np.arange(subset.n_states)) & 1
    known = bits.sum(2) < subset.n_states
    shares = (bits / np.maximum(1, bits.sum(2, keepdims=True)) * known[:, :, None] * subset.counts[None, :, None]).sum((0, 1))
    freqs = np.full(subset.n_states, 1 / subset.n_states) if str(conf.get(section, "statefrequencies", "estimate")).lower() == "equal" else shares / shares.sum()
    if subset.n_states == 20:
        return amino_acid_model(None, freqs, **gamma)
    if rates == "1rate":
        return gtr([1.0] * 6, list(freqs), **gamma)
    if rates == "2rate":
        return hky(2.0, list(freqs), **gamma)
    if rates.startswith("("):
        classes = rate_classes(rates)
        return classed(classes, dict.fromkeys(classes, 1.0), list(freqs), **gamma)
    return gtr([1.0] * 6, list(freqs), **gamma)


class Run:
    """A run of a configuration: checked first, then searched, bootstrapped or scored."""

    def __init__(self, spark: SparkSession, conf_path: str):
        self.spark, self.folder = spark, Path(conf_path).parent
        self.conf = RunConfig.parse(Path(conf_path).read_text())
        wrong = self.conf.validate()
        if wrong:
            raise ValueError("; ".join(wrong))
        get = self.conf.get
        text = (self.folder / get("general", "datafname")).read_text()
        self.blocks = read_blocks(text)
        self.taxa = list(self.blocks[0].rows)
        if any(list(b.rows) != self.taxa for b in self.blocks):
            raise ValueError("matrices of different taxa")
        sections = [k for k in self.conf.sections if k.startswith("model")] or ["general"]
        self.subsets, self.models = [], []
        for b in self.blocks:
            for sub in subsets_of(b):
                section = sections[min(len({s.name.split(".")[0] for s in self.subsets} - {sub.name.split(".")[0]}), len(sections) - 1)]
                sub.kind = str(get(section, "datatype", b.datatype)).lower() if b.datatype not in ("dna", "rna", "nucleotide") else "dna"
                self.subsets.append(sub)
                self.models.append(model_of(self.conf, section, sub))
        path = get("general", "constraintfile")
        self.constraints = [] if path in (None, "none") else parse_constraints((self.folder / path).read_text(), self.taxa)
        self.prefix = self.folder / str(get("general", "ofprefix"))

    def data(self, counts: list[np.ndarray] | None = None) -> list[Likelihood]:
        return [self._one(s, m, s.counts if counts is None else counts[i]) for i, (s, m) in enumerate(zip(self.subsets, self.models))]

    def _one(self, s: Subset, model, counts: np.ndarray) -> Likelihood:
        conditioned = None
        if "variable" in s.kind:  # constant patterns cannot be seen
            conditioned = np.array([[1 << i] * len(self.taxa) for i in range(s.n_states)], np.int64).T
        elif "notallzeros" in s.kind:
            conditioned = np.array([[1]] * len(self.taxa), np.int64)
        return Likelihood(s.masks, self.taxa, counts, model, conditioned)

    def settings(self, seed: int) -> Settings:
        g = self.conf.get
        return Settings(size=int(g("master", "nindivs")), holdover=int(g("master", "holdover")), intensity=float(g("master", "selectionintensity")), interval=int(g("master", "intervallength")), stored=int(g("master", "intervalstostore")), reach=int(g("master", "limsprrange")), topology_patience=int(g("general", "genthreshfortopoterm")), score_patience=float(g("general", "scorethreshforterm")), least_gain=float(g("general", "significanttopochange")), seed=seed)

    def start_trees(self, seed: int, data: list[Likelihood]) -> list:
        kind = str(self.conf.get("general", "streefname")).lower()
        positive = frozenset(c.split for c in self.constraints if c.positive and c.mask == (1 << len(self.taxa)) - 1)
        if kind == "random":
            return [random_tree(self.taxa, seed, positive)]
        if kind == "stepwise":
            return [search(data[0], self.taxa, seed, attachments=int(self.conf.get("general", "attachmentspertaxon")), rounds=0, positive=positive)[0]]
        found = read_blocks((self.folder / kind).read_text())[0].trees
        return [parse_newick(t) for t in found.values()] or [random_tree(self.taxa, seed, positive)]

    def search_replicates(self, replicates: DataFrame, *, stop_after: int | None = None) -> DataFrame:
        """(rep, kind, newick, lnl, generations, state) for rows (rep, kind, seed), each searched by a task of its own; kind is
        search or bootstrap."""
        size = sum(s.masks.nbytes for s in self.subsets)
        if size > MOST_BYTES:
            raise ValueError(f"patterns of {size} bytes are too large to be sent to each task; score them distributed")
        light = {k: v for k, v in self.__dict__.items() if k != "spark"}
        shared = self.spark.sparkContext.broadcast(light)

        def run(batches):
            me = Run.__new__(Run)
            me.__dict__.update(shared.value)
            for b in batches:
                for rep, kind, seed in zip(b["rep"].tolist(), b["kind"].tolist(), b["seed"].tolist()):
                    yield pd.DataFrame([me.one_replicate(rep, kind, seed, stop_after, None)], columns=["rep", "kind", "newick", "lnl", "generations", "state"])

        n = max(1, replicates.count())
        return replicates.repartition(n, "rep").mapInPandas(run, "rep int, kind string, newick string, lnl double, generations long, state string")

    def one_replicate(self, rep: int, kind: str, seed: int, stop_after: int | None, state: State | None) -> tuple:
        counts = None
        if kind == "bootstrap":
            rng = np.random.default_rng([seed, rep])
            share = float(self.conf.get("master", "resampleproportion"))
            counts = [rng.multinomial(round(share * s.counts.sum()), s.counts / s.counts.sum()).astype(float) for s in self.subsets]
        data = self.data(counts)
        full = (1 << len(self.taxa)) - 1
        positive = frozenset(c.split for c in self.constraints if c.positive and c.mask == full)
        negative = frozenset(c.split for c in self.constraints if not c.positive and c.mask == full)
        fits = (lambda t: allowed(t, self.taxa, positive, negative)) if positive or negative else None
        start = [] if state else self.start_trees(seed, data)
        out = evolve(lambda t: total_lnl(data, t), lambda t: optimise_together(data, t, passes=2), start, self.settings(seed), state=state, allow=fits, stop_after=stop_after)
        i = int(np.argmax(out.scores))
        tree = parse_newick(out.trees[i])
        lnl = optimise_together(data, tree, passes=10)
        if self.conf.get("general", "collapsebranches"):
            tree = collapsed(tree)
        outgroup = {self.taxa[k - 1] for k in self.conf.ranges("general", "outgroup") if k <= len(self.taxa)}
        if outgroup:
            tree = rooted_at(tree, outgroup)
        return rep, kind, write_newick(tree), lnl, out.generation, json.dumps(out.as_dict())

    def go(self, *, stop_after: int | None = None) -> DataFrame:
        """All replicates of the configuration; writes what it asks for, and returns the table of the best trees."""
        seed, began = int(self.conf.get("general", "randseed")), time.monotonic()
        seed = seed if seed > 0 else int(time.time())
        boots, reps = int(self.conf.get("master", "bootstrapreps")), int(self.conf.get("general", "searchreps"))
        kind, n = ("bootstrap", boots) if boots else ("search", reps)
        rows = self.spark.createDataFrame([(r, kind, seed + r) for r in range(1, n + 1)], "rep int, kind string, seed long")
        got = self.search_replicates(rows, stop_after=stop_after).toPandas().sort_values("rep")
        trees = {f"{k}{r}": t for r, k, t in zip(got["rep"], got["kind"], got["newick"])}
        self.prefix.parent.mkdir(parents=True, exist_ok=True)
        name = "boot" if boots else "best.all"
        Path(f"{self.prefix}.{name}.tre").write_text(nexus_trees(trees, self.taxa))
        if not boots:
            best = got.loc[got["lnl"].idxmax()]
            Path(f"{self.prefix}.best.tre").write_text(nexus_trees({"best": best["newick"]}, self.taxa))
            if int(self.conf.get("general", "outputsitelikelihoods")):
                self.write_site_likelihoods(best["newick"])
        if self.conf.get("general", "writecheckpoints"):
            Path(f"{self.prefix}.check.json").write_text(json.dumps({"seed": seed, "states": dict(zip(map(str, got["rep"]), got["state"]))}))
        log = ["rep\tgeneration\tlnl"] + [f"{r}\t{g}\t{x:.6f}" for r, s in zip(got["rep"], got["state"]) for g, x in json.loads(s)["log"]]
        Path(f"{self.prefix}.log").write_text("\n".join(log + [f"# {time.monotonic() - began:.1f} s"]) + "\n")
        return self.spark.createDataFrame(got.drop(columns="state"))

    def resume(self, *, stop_after: int | None = None) -> list[tuple]:
        """Searches of the last checkpoint, gone on with."""
        saved = json.loads(Path(f"{self.prefix}.check.json").read_text())
        out = []
        for rep, text in saved["states"].items():
            state = State(**json.loads(text))
            state.log = [tuple(x) for x in state.log]
            out.append(self.one_replicate(int(rep), "search", saved["seed"] + int(rep), stop_after, state))
        return out

    def site_likelihoods(self, newick: str) -> list[tuple[str, int, float]]:
        """(subset, column, lnl) of all columns that take part."""
        tree, out = parse_newick(newick), []
        for s, d in zip(self.subsets, self.data()):
            out += [(s.name, c, float(x)) for places, x in zip(s.columns, d.site_lnl(tree)) for c in places]
        return sorted(out)

    def write_site_likelihoods(self, newick: str) -> None:
        rows = self.site_likelihoods(newick)
        Path(f"{self.prefix}.sitelikes.log").write_text("subset\tcolumn\tlnl\n" + "".join(f"{a}\t{b}\t{c:.8f}\n" for a, b, c in rows))

    def score(self) -> float:
        """lnL of the start tree with its branches optimised."""
        data = self.data()
        return optimise_together(data, self.start_trees(1, data)[0])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("conf")
    p.add_argument("-V", "--validate", action="store_true", help="read everything, run nothing")
    p.add_argument("-r", "--restart", action="store_true", help="go on from the checkpoint")
    p.add_argument("-f", "--score", action="store_true", help="score the start tree only")
    p.add_argument("--generations", type=int, help="stop after so many")
    p.add_argument("-v", "--version", action="version", version="cladeframe")
    a = p.parse_args(argv)
    from .session import build_session

    run = Run(build_session(), a.conf)
    if a.validate:
        print(f"{len(run.taxa)} taxa, {sum(s.masks.shape[1] for s in run.subsets)} patterns in {len(run.subsets)} subsets")
    elif a.score:
        print(f"{run.score():.6f}")
    elif a.restart:
        for rep, _, newick, lnl, generations, _ in run.resume(stop_after=a.generations):
            print(f"{rep}\t{lnl:.6f}\t{generations}\t{newick}")
    else:
        run.go(stop_after=a.generations).show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
