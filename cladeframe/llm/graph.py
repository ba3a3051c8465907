"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for all nodes of the edges (u, v); the component is its least node.

    Each round points every node to its least neighbour and halves the paths by pointer jumping,
    then contracts the edges to the roots. Rounds grow with the logarithm of the longest path. All
    state is in written tables; nothing but row counts reaches the driver.
    """
    c = F.col
    both = lambda e: e.select("u", "v").union(e.select(c("v").alias("u"), c("u").alias("v")))
    rest = scratch.write(both(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), "edges")
    labels = None
    while True:
        least = scratch.write(rest.groupBy("u").agg(F.least(c("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "least")
        while True:
            up = least.select(c("node").alias("root"), c("root").alias("above"))
            jumped = least.select("node", "root").join(up, "root").select("node", c("above").alias("root"), (c("above") != c("root")).alias("moved"))
            jumped = scratch.write(jumped, "jumped")
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(least)
            least = jumped
            if not moved:
                break
        if labels is None:
            labels = scratch.write(least.select("node", c("root").alias("component")), "labels")
        else:
            to = least.select(c("node").alias("component"), "root")
            old, labels = labels, scratch.write(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
            scratch.drop(old)
        a, b = least.select(c("node").alias("u"), c("root").alias("ru")), least.select(c("node").alias("v"), c("root").alias("rv"))
        old, rest = rest, scratch.write(rest.join(a, "u").join(b, "v").select(c("ru").alias("u"), c("rv").alias("v")).where("u <> v").distinct(), "edges")
        scratch.drop(old, least)
        if not rest.limit(1).count():
            scratch.drop(rest)
            return labels


class Labels:
    """Components that grow as links come in. New links are contracted to the components known so far, so a
    round costs its own links and one pass over the labels."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.table = scratch.spark.createDataFrame([], "node long, component long")
        self.empty = True

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their node; a node without links is its own."""
        if self.empty:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.table, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def add(self, links: DataFrame) -> bool:
        """Take in links (u, v); whether any joins two components."""
        c, scratch = F.col, self.scratch
        end = lambda x, name: self.of(x.withColumnRenamed(name, "node")).drop("node").withColumnRenamed("component", name)
        fresh = scratch.write(end(end(links, "u"), "v").where("u <> v").distinct(), "fresh")
        if not fresh.limit(1).count():
            scratch.drop(fresh)
            return False
        merged = components(fresh, scratch)
        if self.empty:
            self.table, self.empty = merged, False
        else:
            to = merged.select(c("node").alias("component"), c("component").alias("root"))
            known = self.table.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            old, self.table = self.table, scratch.write(known.unionByName(merged.join(self.table, "node", "left_anti")), "labels")
            scratch.drop(old, merged)
        scratch.drop(fresh)
        return True
