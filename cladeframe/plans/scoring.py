"""Distributed scoring and searching: rows of trees, of pattern chunks and of replicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.likelihood import Likelihood
from ..kernels.models import Model
from ..kernels.search import search
from ..sources.newick import parse_newick, write_newick

#: Patterns scored at once; a chunk's partials take nodes x classes x states x this x 8 bytes.
CHUNK = 4096


def site_likelihoods(patterns: DataFrame, trees: DataFrame, model: Model, taxa: list[str]) -> DataFrame:
    """(tree_id, first_site, count, lnl) of each pattern under each tree. Patterns, which may be many, stay
    distributed and are scored in chunks; the trees (tree_id, newick) are a stated, small set and are broadcast."""
    rows = [(r["tree_id"], r["newick"]) for r in trees.select("tree_id", "newick").collect()]
    shared = patterns.sparkSession.sparkContext.broadcast((rows, model, taxa))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m, names = shared.value
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                data = Likelihood(np.array(part["p"].tolist(), np.int64).T, names, part["count"].to_numpy(), m)
                for tree_id, newick in known:
                    yield pd.DataFrame({"tree_id": tree_id, "first_site": part["first_site"], "count": part["count"], "lnl": data.site_lnl(parse_newick(newick))})

    kind = trees.schema["tree_id"].dataType.simpleString()
    return patterns.select("p", "count", "first_site").mapInPandas(run, f"tree_id {kind}, first_site long, count long, lnl double")


def score_trees(patterns: DataFrame, trees: DataFrame, model: Model, taxa: list[str]) -> DataFrame:
    """Total lnL of each tree: the sum over patterns of count times lnL."""
    return site_likelihoods(patterns, trees, model, taxa).groupBy("tree_id").agg(F.sum(F.col("count") * F.col("lnl")).alias("lnl"))


def search_replicates(patterns: DataFrame, counts: DataFrame, model: Model, taxa: list[str]) -> DataFrame:
    """One search for each replicate of ``counts`` (rep, first_site, n), as by bootstrapping: (rep, newick, lnl).
    Collapsed patterns are small and are broadcast; each replicate is a group of its own, hence a task."""
    p = patterns.select("first_site", "p").toPandas()
    shared = patterns.sparkSession.sparkContext.broadcast((p["first_site"].to_numpy(), np.array(p["p"].tolist(), np.int64).T, model, taxa))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sites, masks, m, names = shared.value
        weight = dict(zip(group["first_site"], group["n"]))
        n = np.array([weight.get(s, 0) for s in sites])
        tree, lnl = search(Likelihood(masks[:, n > 0], names, n[n > 0], m), names, int(group["rep"].iloc[0]))
        return pd.DataFrame({"rep": [int(group["rep"].iloc[0])], "newick": [write_newick(tree)], "lnl": [lnl]})

    return counts.groupBy("rep").applyInPandas(run, "rep int, newick string, lnl double")


def ancestral_states(patterns: DataFrame, newick: str, model: Model, taxa: list[str]) -> DataFrame:
    """(node, first_site, best, probs) for the inner nodes of a tree."""
    shared = patterns.sparkSession.sparkContext.broadcast((newick, model, taxa))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, m, names = shared.value
        for b in batches:
            tree = parse_newick(text)
            data = Likelihood(np.array(b["p"].tolist(), np.int64).T, names, b["count"].to_numpy(), m)
            for node, kids in enumerate(tree.children()):
                if kids:
                    probs = data.ancestral(tree, node)
                    yield pd.DataFrame({"node": node, "first_site": b["first_site"], "best": probs.argmax(1), "probs": list(probs)})

    return patterns.select("p", "count", "first_site").mapInPandas(run, "node int, first_site long, best int, probs array<double>")


def optimise_tree(weighted: DataFrame, newick: str, model: Model, taxa: list[str]) -> DataFrame:
    """Branch lengths that maximise lnL for each data set of ``weighted`` (rep, first_site, n, p): (rep, newick,
    lnl). A data set is a group of collapsed patterns and is one task."""
    shared = weighted.sparkSession.sparkContext.broadcast((newick, model, taxa))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        text, m, names = shared.value
        tree = parse_newick(text)
        lnl = Likelihood(np.array(group["p"].tolist(), np.int64).T, names, group["n"].to_numpy(), m).optimise_branches(tree)
        return pd.DataFrame({"rep": [int(group["rep"].iloc[0])], "newick": [write_newick(tree)], "lnl": [lnl]})

    return weighted.groupBy("rep").applyInPandas(run, "rep int, newick string, lnl double")
