"""State and codon frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_pass(patterns: DataFrame, full: int) -> DataFrame:
    """Frequencies of states; an ambiguous cell counts in equal parts, a fully ambiguous one not at all.
    Aggregates to one row for each mask before it is split into states."""
    masks = patterns.select("count", F.explode_outer("p").alias("mask")).groupBy("mask").agg(F.sum("count").alias("n")).where(F.col("mask") != full)
    bits = F.filter(F.array(*[F.lit(1 << i) for i in range(full.bit_length())]), lambda b: b.bitwiseAND(F.col("mask")) != 0)
    states = masks.select((F.col("n") / F.bit_count("mask")).alias("share"), F.explode_outer(bits).alias("state"))
    w = Window.partitionBy(F.lit(0))
    return states.groupBy("state").agg(F.sum("share").alias("share")).select("state", (F.col("share") / F.sum("share").over(w)).alias("freq"))


def with_pseudocount(counts: DataFrame, states: DataFrame) -> DataFrame:
    """Frequencies over a dimension of states; if one was not seen, every state counts one more."""
    w = Window.partitionBy(F.lit(0))
    d = states.join(counts, "state", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    d = d.withColumn("n", F.col("n") + F.when(F.min("n").over(w) == 0, 1).otherwise(0))
    return d.withColumn("freq", F.col("n") / F.sum("n").over(w))


def codon_frequencies(usage: DataFrame, code: DataFrame, *, by_position: bool) -> DataFrame:
    """Products of base frequencies over codons that are no stop, renormalised. ``usage`` has (pos 0..2,
    base, n); pooled over positions, or by position, where a base that is absent raises an error."""
    keys = ["pos", "base"] if by_position else ["base"]
    w = Window.partitionBy("pos") if by_position else Window.partitionBy(F.lit(0))
    f = usage.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(w))
    if by_position:
        f = f.withColumn("_kinds", F.count("*").over(w)).withColumn("f", F.when(F.col("_kinds") < 4, F.raise_error(F.lit("a base is absent at a position")).cast("double")).otherwise(F.col("f")))
    out = code.where("aa <> '*'")
    for k in range(3):
        side = f.where(F.col("pos") == k) if by_position else f
        side = side.select(F.col("base").alias(f"b{k}"), F.col("f").alias(f"f{k}"))
        out = out.join(F.broadcast(side), F.substring("codon", k + 1, 1) == F.col(f"b{k}"))
    out = out.withColumn("f", F.col("f0") * F.col("f1") * F.col("f2"))
    return out.select("codon", "aa", (F.col("f") / F.sum("f").over(Window.partitionBy(F.lit(0)))).alias("freq"))


def refined(patterns: DataFrame, full: int, *, precision: float = 1e-8) -> dict[int, float]:
    """Frequencies of states by expectation and maximisation: an ambiguous cell counts in parts that go as the
    frequencies themselves. The data reach the driver as one count for each mask, fewer than 2**states."""
    rows = patterns.select("count", F.explode("p").alias("mask")).groupBy("mask").agg(F.sum("count").alias("n")).where(F.col("mask") != full).collect()
    states = [1 << i for i in range(full.bit_length())]
    freq = dict.fromkeys(states, 1 / len(states))
    while rows:
        got = dict.fromkeys(states, 0.0)
        for r in rows:
            mine = [s for s in states if r["mask"] & s]
            share = sum(freq[s] for s in mine)
            for s in mine:
                got[s] += r["n"] * freq[s] / share if share else 0.0
        total = sum(got.values())
        new = {s: got[s] / total for s in states}
        done = max(abs(new[s] - freq[s]) for s in states) < precision
        freq = new
        if done:
            break
    return freq
