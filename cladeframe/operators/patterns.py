"""Site patterns: collapse, classify, summarise, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern_text(p: str = "p") -> Column:
    return F.array_join(F.transform(p, lambda x: x.cast("string")), ",")


def _fold(p: str, zero: int, step) -> Column:
    return F.aggregate(p, F.lit(zero), step)


def constant_mask(p: str, full: int) -> Column:
    """States that all taxa allow; not 0 means a constant site."""
    return _fold(p, full, lambda a, x: a.bitwiseAND(x))


def observed_states(p: str) -> Column:
    """Mask of the states that some taxon has without ambiguity."""
    return _fold(p, 0, lambda a, x: a.bitwiseOR(F.when(F.bit_count(x) == 1, x).otherwise(0)))


def pattern_type(p: str, full: int) -> Column:
    """missing; constant; informative, where two states are each in two taxa or more; else uninformative."""
    is_state = lambda s: lambda x: x == s
    twice = sum((F.when(F.size(F.filter(p, is_state(1 << i))) >= 2, 1).otherwise(0) for i in range(full.bit_length())), F.lit(0))
    missing = F.size(F.filter(p, lambda x: x != full)) == 0
    return F.when(missing, "missing").when(constant_mask(p, full) != 0, "constant").when(twice >= 2, "informative").otherwise("uninformative")


def collapse(sites: DataFrame, *, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Merge equal columns: (p, count, first_site). Weights default to 1; columns of weight 0 are dropped."""
    w = F.lit(1) if weight is None else weight
    out = sites.withColumn("_w", w.cast("long")).groupBy(*(keys or []), "p").agg(F.sum("_w").alias("count"), F.min("site").alias("first_site"))
    return out.where("count > 0")


def describe(patterns: DataFrame, full: int) -> DataFrame:
    out = patterns.withColumn("pattern", pattern_text()).withColumn("n_states", F.bit_count(observed_states("p")).cast("int"))
    return out.withColumn("const_mask", constant_mask("p", full)).withColumn("ptype", pattern_type("p", full))


def uncollapse(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Carry a value of each pattern back to the sites that have it."""
    return sites.join(results, "p")


def previous_in_order(df: DataFrame, order: str, value: str, out: str, *, block: int = 4096) -> DataFrame:
    """``lag(value)`` over the whole table in order of a unique number, without one task that sorts it all:
    lags run within blocks of the number; the first row of a block takes the last value of the nearest
    block below that has rows, from a table of one row for each block."""
    key = F.floor(F.col(order) / block).cast("long")
    d = df.withColumn("_block", key)
    last = d.groupBy("_block").agg(F.max_by(value, order).alias("_last"))
    # One row a block: the table is smaller by the block's size. Its own lags run in blocks of blocks, as long as
    # there may be many, so that no task sorts all of them.
    far = last.withColumn("_far", F.floor(F.col("_block") / block).cast("long"))
    far_last = far.groupBy("_far").agg(F.max_by("_last", "_block").alias("_far_last"))
    wf = Window.partitionBy(F.lit(0)).orderBy("_far")
    far_before = far_last.select("_far", F.lag("_far_last").over(wf).alias("_far_before"))
    wb = Window.partitionBy("_far").orderBy("_block")
    before = far.join(far_before, "_far").select("_block", F.when(F.row_number().over(wb) == 1, F.col("_far_before")).otherwise(F.lag("_last").over(wb)).alias("_before"))
    w = Window.partitionBy("_block").orderBy(order)
    d = d.join(before, "_block").withColumn("_first", F.row_number().over(w) == 1)
    return d.withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.lag(value).over(w))).drop("_block", "_before", "_first")


def drop_adjacent_equal(sites: DataFrame) -> DataFrame:
    """Keep the first of neighbouring sites of equal patterns."""
    return previous_in_order(sites, "site", "p", "_prev").where(~F.col("p").eqNullSafe(F.col("_prev"))).drop("_prev")


def pair_distances(patterns: DataFrame, n_taxa: int) -> DataFrame:
    """For all pairs of taxa the weights of compared and of differing sites; ambiguous cells are skipped.
    Runs over collapsed patterns, with the pairs as a fixed list in each row, so no join is needed."""
    pairs = F.array(*[F.struct(F.lit(a + 1).alias("taxon_a"), F.lit(b + 1).alias("taxon_b"), F.get("p", F.lit(a)).alias("x"), F.get("p", F.lit(b)).alias("y")) for a in range(n_taxa) for b in range(a + 1, n_taxa)])
    d = patterns.select("count", F.explode_outer(pairs).alias("s")).select("count", "s.*")
    both = (F.bit_count("x") == 1) & (F.bit_count("y") == 1)
    zero = F.lit(0).cast("long")
    return d.groupBy("taxon_a", "taxon_b").agg(F.sum(F.when(both, F.col("count")).otherwise(zero)).alias("compared"), F.sum(F.when(both & (F.col("x") != F.col("y")), F.col("count")).otherwise(zero)).alias("different"))


def running_total(df: DataFrame, bucket: list[Column], order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over all rows up to each, in order of the buckets and then of ``order`` within a bucket.

    Only the bucket's sums, one row each, meet in one task; buckets must be coarse, and agree with the order.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    d = df.select("*", value.cast("long").alias("_v"), *[x.alias(n) for x, n in zip(bucket, names)])
    above = Window.partitionBy(F.lit(0)).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*names).agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(above), F.lit(0).cast("long"))).drop("_s")
    within = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"d.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    d = d.alias("d").join(sums.alias("s"), same).select("d.*", "_o")
    return d.withColumn(out, F.col("_o") + F.sum("_v").over(within)).drop("_v", "_o", *names)


def in_pattern_order(patterns: DataFrame, full: int) -> DataFrame:
    """Number patterns from 1: constant ones first, then by their states taxon by taxon. Rows are bucketed by the first
    two taxa, so that a position needs no sort of all patterns in one task."""
    varies = (constant_mask("p", full) == 0).cast("int")
    return running_total(patterns, [varies, F.get("p", F.lit(0)), F.get("p", F.lit(1))], [F.col("p")], F.lit(1), "position")


def drop_taxa(sites: DataFrame, inactive: list[int]) -> DataFrame:
    """Sites without some taxa, given by number from 1."""
    gone = F.array(*[F.lit(t) for t in inactive]) if inactive else F.array().cast("array<int>")
    return sites.withColumn("p", F.filter("p", lambda x, i: ~F.array_contains(gone, i + 1)))


def add_taxon(sites: DataFrame, mask: int) -> DataFrame:
    """Sites with one more taxon that has the same state everywhere, such as a root that may be anything."""
    return sites.withColumn("p", F.concat("p", F.array(F.lit(mask))))


def without_missing(patterns: DataFrame, full: int) -> DataFrame:
    """Patterns in which some taxon is known."""
    return patterns.where(F.exists("p", lambda x: x != full))


def partly_ambiguous(cells: DataFrame, full: int) -> DataFrame:
    """How many cells of each taxon have some states, but neither one nor all (taxon, n_partial)."""
    part = (F.bit_count("mask") > 1) & (F.col("mask") != full)
    return cells.groupBy("taxon").agg(F.sum(part.cast("long")).alias("n_partial"))


def in_subsets(sites: DataFrame, subsets: DataFrame) -> DataFrame:
    """Sites in the subsets of a character partition, whose ranges (subset, first, last, step) are a short list. A
    site in two subsets raises an error; sites in none are left out."""
    r = F.broadcast(subsets)
    got = sites.join(r, (sites["site"] >= r["first"]) & (sites["site"] <= r["last"]) & ((sites["site"] - r["first"]) % r["step"] == 0))
    return got.drop("first", "last", "step")


def column_ranges(columns: DataFrame, *, block: int = 4096) -> DataFrame:
    """Numbers (site) as ranges (first, last) that end at the borders of blocks."""
    d = columns.select("site").distinct().withColumn("_block", F.floor(F.col("site") / block))
    w = Window.partitionBy("_block").orderBy("site")
    d = d.withColumn("_run", F.col("site") - F.row_number().over(w))
    return d.groupBy("_block", "_run").agg(F.min("site").alias("first"), F.max("site").alias("last")).select("first", "last")


def codons(cells: DataFrame, full: int) -> DataFrame:
    """Cells (taxon, site from 1, mask of A=1 C=2 G=4 T=8) to codons (taxon, codon from 0, codon_index): three sites
    each; null where one of them is absent or not a single base."""
    base = F.when(F.bit_count("mask") == 1, F.log2("mask").cast("int"))
    k = (F.col("site") - 1) % 3
    at = lambda j: F.max(F.when(k == j, base))
    d = cells.where(F.col("mask") != full).groupBy("taxon", F.floor((F.col("site") - 1) / 3).alias("codon"))
    return d.agg((at(0) * 16 + at(1) * 4 + at(2)).alias("codon_index"))


def translated(coded: DataFrame, code: DataFrame, *, ignore_stops: bool = False) -> DataFrame:
    """Amino acids of codons: ``?`` for unknown ones. A stop raises an error, or with ``ignore_stops`` is unknown."""
    out = coded.join(F.broadcast(code.select("codon_index", "aa")), "codon_index", "left").withColumn("aa", F.coalesce("aa", F.lit("?")))
    stop = F.lit("?") if ignore_stops else F.raise_error(F.lit("a stop codon")).cast("string")
    return out.withColumn("aa", F.when(F.col("aa") == "*", stop).otherwise(F.col("aa")))
