"""Populations of scored trees as tables: selection, edits, progress, mutation kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the kinds of mutations.
KINDS = {"nni": 1, "spr_random": 2, "spr_limited": 4, "branch": 8, "rates": 16, "frequencies": 32, "alpha": 64, "invariant": 128}
ANY_TOPOLOGY = KINDS["nni"] | KINDS["spr_random"] | KINDS["spr_limited"]
ANY_MODEL = KINDS["rates"] | KINDS["frequencies"] | KINDS["alpha"] | KINDS["invariant"]


def selection(df: DataFrame, group: str, score: str, order: list[str], *, intensity: float, holdover: int = 0) -> DataFrame:
    """Reproduction probabilities of individuals by score, and their running sum in order of the rank.

    An individual's weight falls with its distance from the best as exp(-intensity distance); the ``holdover`` best
    are marked, as they live on as they are.
    """
    w = Window.partitionBy(group)
    by = w.orderBy(F.desc(score), *order)
    d = df.withColumn("rank", F.row_number().over(by)).withColumn("_w", F.exp(-intensity * (F.max(score).over(w) - F.col(score))))
    d = d.withColumn("prob", F.col("_w") / F.sum("_w").over(w)).withColumn("kept", F.col("rank") <= holdover)
    return d.withColumn("cumulative", F.sum("prob").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_w")


def parents(selected: DataFrame, group: str, draws: DataFrame) -> DataFrame:
    """The individual that each draw (group, child, u) descends from: the first whose running sum reaches u."""
    hit = draws.join(selected, group).where(F.col("cumulative") >= F.col("u"))
    return hit.groupBy(group, "child").agg(F.min("rank").alias("rank"))


def resized(population: DataFrame, group: str, size: int) -> DataFrame:
    """Populations of just ``size``: the worst go, or the best is cloned. Needs a rank from 1."""
    kept = population.where(F.col("rank") <= size)
    n = population.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") < size)
    clones = population.where("rank = 1").join(n, group).withColumn("rank", F.explode(F.sequence((F.col("_n") + 1).cast("int"), F.lit(size)))).drop("_n")
    return kept.unionByName(clones)


def swapped(population: DataFrame, group: str, a, b, rank: int) -> DataFrame:
    """Two populations exchange the individuals of a rank, as in a migration."""
    to = F.when(F.col(group) == a, F.lit(b)).when(F.col(group) == b, F.lit(a)).otherwise(F.col(group))
    return population.withColumn(group, F.when(F.col("rank") == rank, to).otherwise(F.col(group)))


def progress(df: DataFrame, run: str, generation: str, score: str, *, patience: int, least: float = 0.0) -> DataFrame:
    """For each generation of a run: its share of all, the best score so far, the last generation that improved it by more
    than ``least``, and whether it is done: no improvement for ``patience`` generations."""
    upto = Window.partitionBy(run).orderBy(generation).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy(generation).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("number", F.count("*").over(upto)).withColumn("fraction", F.col("number") / F.count("*").over(Window.partitionBy(run)))
    d = d.withColumn("best", F.max(score).over(upto))
    better = F.max(score).over(before).isNull() | (F.col(score) > F.max(score).over(before) + least)
    d = d.withColumn("_better", F.when(better, F.col("number"))).withColumn("improved", F.max("_better").over(upto)).drop("_better")
    return d.withColumn("done", F.col("number") - F.col("improved") >= patience)


def has_kind(kinds: Column, bits: int) -> Column:
    return kinds.bitwiseAND(F.lit(bits)) != 0


def kind_counts(df: DataFrame, kinds: str) -> DataFrame:
    """Individuals of each kind of mutation, and of the composites any_topology and any_model (kind, n)."""
    all_kinds = KINDS | {"any_topology": ANY_TOPOLOGY, "any_model": ANY_MODEL}
    wide = df.agg(*[F.sum(has_kind(F.col(kinds), b).cast("long")).alias(k) for k, b in all_kinds.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in all_kinds])).alias("x")).select("x.*")


def distinct_topologies(splits: DataFrame, tree: str, split: str) -> DataFrame:
    """Trees with the same set of splits as one: (splits, n_trees, first_tree)."""
    sets = splits.groupBy(tree).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return sets.groupBy("splits").agg(F.count("*").alias("n_trees"), F.min(tree).alias("first_tree"))
