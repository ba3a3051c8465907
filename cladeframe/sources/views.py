"""Character matrices and trees seen in the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Taxa of the return-flag matrix, and the mask of a cell that may be any of its three states.
FLAG_TAXA, FLAG_FULL = range(1, 8), 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag_mask(flag: Column) -> Column:
    return F.when(flag == "A", 1).when(flag == "N", 2).when(flag == "R", 4)


def returnflag_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (site, taxon, mask): order by line number; repeated lines make a polymorphic cell."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("taxon")).agg(F.bit_or(flag_mask(F.col("l_returnflag"))).alias("mask"))


def returnflag_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites (site, p): one state mask for each taxon, absent cells fully ambiguous. One shuffle: cells
    are merged into columns of the site by conditional aggregates, combined before the exchange."""
    li = table(spark, sf_dir, "lineitem")
    mask = flag_mask(F.col("l_returnflag"))
    each = [F.coalesce(F.bit_or(F.when(F.col("l_linenumber") == t, mask)), F.lit(FLAG_FULL)) for t in FLAG_TAXA]
    return li.groupBy(F.col("l_orderkey").alias("site")).agg(F.array(*each).alias("p"))


def priority_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites (site, p) of customers by order priority; states are order status bits, absent cells ambiguous."""
    o = table(spark, sf_dir, "orders")
    mask = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    taxa = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    each = [F.coalesce(F.bit_or(F.when(F.col("o_orderpriority") == t, mask)), F.lit(7)) for t in taxa]
    return o.groupBy(F.col("o_custkey").alias("site")).agg(F.array(*each).alias("p"))


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes (node, parent, label): a root, regions, nations, suppliers and customers."""
    root = spark.createDataFrame([("root", None, "root")], "node string, parent string, label string")
    level = lambda df, key, up, name, prefix, above: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), F.concat(F.lit(above), F.col(up).cast("string")).alias("parent"), F.col(name).alias("label"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"), F.col("r_name").alias("label"))
    nations = level(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", "n_name", "n", "r")
    suppliers = level(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_name", "s", "n")
    customers = level(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_name", "c", "n")
    return root.unionByName(regions).unionByName(nations).unionByName(suppliers).unionByName(customers)
