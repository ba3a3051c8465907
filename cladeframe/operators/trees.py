"""Trees as tables of nodes (node, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(nodes: DataFrame, max_depth: int) -> DataFrame:
    """Closure (node, ancestor, distance), each node being its own ancestor at distance 0; trees up to
    ``max_depth`` edges deep. One join for each level, all lazy. A deeper tree raises an error."""
    up = nodes.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    level = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    out = level
    for k in range(1, max_depth + 2):
        level = level.join(up, F.col("ancestor") == F.col("_n")).where(F.col("_p").isNotNull()).select("node", F.col("_p").alias("ancestor"), F.lit(k).alias("distance"))
        if k <= max_depth:
            out = out.unionByName(level)
    # The message is made of both sides of the last join, so that nothing raises before it.
    deeper = F.raise_error(F.concat_ws(" ", F.lit(f"deeper than {max_depth}:"), F.col("node").cast("string"), F.col("ancestor").cast("string"))).cast("int")
    return out.unionByName(level.select("node", "ancestor", deeper.alias("distance")))


def tip_splits(nodes: DataFrame, tips: DataFrame, max_depth: int) -> DataFrame:
    """(node, split) of the tips below each node; ``tips`` has (node, bit)."""
    return ancestors(nodes, max_depth).join(tips, "node").groupBy(F.col("ancestor").alias("node")).agg(F.bit_or("bit").alias("split"))


def distances(nodes: DataFrame, chosen: DataFrame, max_depth: int) -> DataFrame:
    """Edges between all pairs (a < b) of the ``chosen`` nodes, which are few: over the last common ancestor."""
    up = ancestors(nodes, max_depth).join(F.broadcast(chosen.select("node")), "node")
    a = up.select(F.col("node").alias("a"), "ancestor", F.col("distance").alias("da"))
    b = up.select(F.col("node").alias("b"), "ancestor", F.col("distance").alias("db"))
    return a.join(b, "ancestor").where("a < b").groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("distance"))


def collapse_short(nodes: DataFrame, short: DataFrame, max_depth: int) -> DataFrame:
    """Nodes without the inner branches above the ``short`` nodes: their children hang on the nearest ancestor that stays.
    Tips stay, however short."""
    inner = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    gone = short.select("node").join(inner, "node", "left_semi").join(nodes.where("parent IS NOT NULL").select("node"), "node", "left_semi")
    kept = nodes.join(gone, "node", "left_anti")
    up = ancestors(nodes, max_depth).where("distance > 0").join(kept.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    nearest = up.groupBy("node").agg(F.min_by("ancestor", "distance").alias("parent"))
    return kept.drop("parent").join(nearest, "node", "left")


def rerooted(nodes: DataFrame, root: str, max_depth: int) -> DataFrame:
    """Nodes (node, parent) of the same tree with another node as its root: the path to it is turned round."""
    path = ancestors(nodes, max_depth).where(F.col("node") == root).select(F.col("ancestor").alias("_a"), "distance")
    below = path.select((F.col("distance") + 1).alias("distance"), F.col("_a").alias("_child"))
    turned = path.join(below, "distance", "left").select(F.col("_a").alias("node"), F.col("_child").alias("_new"), F.lit(True).alias("_on"))
    out = nodes.join(F.broadcast(turned), "node", "left")
    return out.withColumn("parent", F.when(F.col("_on"), F.col("_new")).otherwise(F.col("parent"))).drop("_new", "_on")


def nearest_tips(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(node, distance, tip): for each inner node the nearest tip below it, the least name on ties."""
    inner = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    tips = nodes.join(inner, "node", "left_anti").select("node")
    up = ancestors(nodes, max_depth).join(tips, "node").where("distance > 0")
    best = up.groupBy(F.col("ancestor").alias("node")).agg(F.min(F.struct("distance", F.col("node").alias("tip"))).alias("m"))
    return best.select("node", "m.distance", "m.tip")


def reconnections(nodes: DataFrame, cut: DataFrame, max_depth: int, reach: int) -> DataFrame:
    """Where the subtrees below the ``cut`` nodes can be attached again: branches, named by their lower node, at a
    distance of 1 to ``reach`` edges, none of the subtree itself, nor those beside the cut. (cut, node, distance)."""
    c = F.col
    up = ancestors(nodes, max_depth)
    from_cut = up.join(F.broadcast(cut.select("node")), "node").select(c("node").alias("cut"), "ancestor", c("distance").alias("da"))
    found = from_cut.join(up.select(c("node").alias("to"), "ancestor", c("distance").alias("db")), "ancestor")
    found = found.groupBy("cut", "to").agg(F.min(c("da") + c("db")).alias("edges"), F.max((c("ancestor") == c("cut")).cast("int")).alias("inside"), F.max((c("to") == c("ancestor")).cast("int")).alias("above"))
    has_branch = nodes.where("parent IS NOT NULL").select(c("node").alias("to"))
    found = found.where("inside = 0").join(has_branch, "to")
    # A branch above the cut begins an edge farther than its lower node says; one beside it an edge nearer.
    found = found.withColumn("distance", F.when(c("above") == 1, c("edges") - 1).otherwise(c("edges") - 2))
    return found.where(c("distance").between(1, reach)).select("cut", c("to").alias("node"), "distance")
