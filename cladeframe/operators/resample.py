"""Resampling of pattern counts with a counter-based minimal-standard generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import running_total

#: Fixed values of the generator x' = 16807 x mod (2**31 - 1).
MULTIPLIER, MODULUS = 16807, 2147483647
#: Draws made from one row.
BLOCK = 4096


def powers_of_two(bits: int = 40) -> list[int]:
    """The multiplier to the powers of two, which make any jump ahead."""
    return [pow(MULTIPLIER, 1 << k, MODULUS) for k in range(bits)]


def jumped(seed: Column, steps: Column, bits: int = 40) -> Column:
    """The state of the generator so many steps after a seed, bit by bit, so that each draw is made by itself."""
    powers = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(powers_of_two(bits))])
    return F.aggregate(powers, seed.cast("long"), lambda x, p: F.when(steps.bitwiseAND(p["bit"]) != 0, x * p["m"] % MODULUS).otherwise(x))


def lcg_replicates(patterns: DataFrame, replicates: int, seed: int, *, proportion: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Draws (keys, rep, draw, x), as many for each replicate as ``proportion`` of what the counts of ``patterns`` sum to.

    All draws are one stream: replicate r begins where the one before ends, and with ``keys`` each subset begins
    where the one before it ends, so that no two share numbers. No list of draws is on the driver.
    """
    spark, c, keys = patterns.sparkSession, F.col, keys or []
    total = patterns.groupBy(*keys).agg(F.sum("count").alias("total")).where("total > 0") if keys else patterns.agg(F.sum("count").alias("total")).where("total > 0")
    total = total.withColumn("total", F.round(c("total") * proportion).cast("long"))
    # One row for each subset; their sum is the length of a replicate.
    one = Window.partitionBy(F.lit(0))
    before = one.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1) if keys else None
    total = total.withColumn("skip", F.coalesce(F.sum("total").over(before), F.lit(0)) if keys else F.lit(0).cast("long")).withColumn("each", F.sum("total").over(one))
    reps = spark.range(1, replicates + 1).select(c("id").cast("int").alias("rep"))
    blocks = reps.join(F.broadcast(total)).where("total > 0").select(*keys, "rep", "total", "skip", "each", F.explode(F.sequence(F.lit(0), F.floor((c("total") - 1) / BLOCK))).alias("block"))
    # A block jumps to its start, a draw from there.
    step = (c("rep") - 1) * c("each") + c("skip") + c("block") * BLOCK
    blocks = blocks.withColumn("step", step).select(*keys, "rep", "total", "block", jumped(F.lit(seed), c("step")).alias("start"))
    draws = blocks.repartition(*keys, "rep", "block").select(*keys, "rep", "block", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.least(c("total") - c("block") * BLOCK, F.lit(BLOCK)))).alias("i"))
    return draws.select(*keys, "rep", (c("block") * BLOCK + c("i")).alias("draw"), jumped(c("start"), c("i"), BLOCK.bit_length()).alias("x"))


def bootstrap_counts(patterns: DataFrame, draws: DataFrame, *, order: str, width: int = 64, keys: list[str] | None = None) -> DataFrame:
    """Counts of patterns per replicate: a draw x hits the pattern whose cumulative interval holds x mod N.
    The range join is an equi-join on buckets of ``width``, each pattern in the buckets it spans. Cumulative counts
    run in blocks of 4096 of the order, so that no task sorts all patterns."""
    c, keys = F.col, keys or []
    block = [c(k) for k in keys] + [F.floor(c(order) / 4096)]
    p = running_total(patterns, block, [c(order)], c("count"), "hi").withColumn("lo", c("hi") - c("count"))
    if keys:  # within each subset from 0
        p = p.join(p.groupBy(*keys).agg(F.min("lo").alias("base")), keys).withColumn("hi", c("hi") - c("base")).withColumn("lo", c("lo") - c("base"))
    p = p.select(*keys, order, "lo", "hi", F.explode_outer(F.sequence(F.floor(c("lo") / width), F.floor((c("hi") - 1) / width))).alias("bucket"))
    total = patterns.groupBy(*keys).agg(F.sum("count").alias("total")) if keys else patterns.agg(F.sum("count").alias("total"))
    d = draws.join(F.broadcast(total), keys) if keys else draws.join(F.broadcast(total))
    d = d.withColumn("u", c("x") % c("total")).withColumn("bucket", F.floor(c("u") / width))
    # Draws are made by exploding a few rows, so that the planner takes them for a small table; it must not broadcast them.
    hit = d.join(p.hint("merge"), [*keys, "bucket"]).where((c("u") >= c("lo")) & (c("u") < c("hi")))
    return hit.groupBy(*keys, "rep", order).agg(F.count("*").alias("n"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) for each key: the generator's next state from key and seed, as a share of the modulus."""
    return jumped((key.cast("long") + seed) % (MODULUS - 1) + 1, F.lit(3).cast("long"), 2) / MODULUS


def ratchet(patterns: DataFrame, seed: int, *, up: float = 0.25, down: float = 0.25) -> DataFrame:
    """Reweight patterns: one more with probability ``up``, one less, but not below 0, with ``down``. The original count
    stays beside the new one (orig_count, count), so that ``reset`` can bring it back."""
    u = uniform(F.col("first_site"), seed)
    change = F.when(u < up, 1).when(u >= 1 - down, -1).otherwise(0)
    return patterns.withColumnRenamed("count", "orig_count").withColumn("count", F.greatest(F.lit(0).cast("long"), F.col("orig_count") + change))


def reset(patterns: DataFrame) -> DataFrame:
    """Bring the original counts back."""
    return patterns.withColumn("count", F.col("orig_count")).drop("orig_count")


def without_conditioned(patterns: DataFrame, conditioned: DataFrame) -> DataFrame:
    """Patterns that may be drawn: those (p) that a model conditions on are no data."""
    return patterns.join(F.broadcast(conditioned.select("p")), "p", "left_anti")


def exponential(u: Column, rate: float) -> Column:
    return -F.ln(u) / rate


def shuffled(df: DataFrame, key: Column, seed: int) -> Column:
    """A number to order rows by, at random but always alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
