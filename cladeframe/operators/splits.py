"""Split (bipartition) algebra on bit masks of taxa, taxon 1 as bit 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(split: Column, full: int) -> Column:
    return split.bitwiseXOR(F.lit(full).cast("long"))


def standardised(split: Column, full: int) -> Column:
    """The side that has the first taxon."""
    return F.when(split.bitwiseAND(F.lit(1).cast("long")) == 0, complement(split, full)).otherwise(split)


def compatible(a: Column, b: Column, full: int) -> Column:
    """Four-point test: one of the four intersections of the sides is empty."""
    na, nb = complement(a, full), complement(b, full)
    both = lambda x, y: x.bitwiseAND(y) == 0
    return both(a, b) | both(a, nb) | both(na, b) | both(na, nb)


def is_subset(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b) == b


def render(split: Column, n_taxa: int) -> Column:
    """``*`` for taxa in the split and ``-`` for others."""
    return F.concat(*[F.when(split.bitwiseAND(F.lit(1 << i).cast("long")) != 0, "*").otherwise("-") for i in range(n_taxa)])


def state_split(p: str, state: int) -> Column:
    """Taxa of a pattern that have exactly this state."""
    bits = F.transform(p, lambda x, i: F.when(x == state, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("w")), lambda a, b: F.struct((a["s"] + b * a["w"]).alias("s"), (a["w"] * 2).alias("w")))["s"]


def satisfying(rows: DataFrame, constraints: DataFrame, *, negative: bool = False) -> DataFrame:
    """Rows whose standardised split is (or with ``negative`` is not) among the constraints'."""
    return rows.join(constraints, "split", "left_anti" if negative else "left_semi")


def equal_within(a: Column, b: Column, mask: Column) -> Column:
    """Whether two splits are one on the taxa of a mask, seen from either side."""
    x, y = a.bitwiseAND(mask), b.bitwiseAND(mask)
    return (x == y) | (x == mask.bitwiseXOR(y))


def subset_within(a: Column, b: Column, mask: Column) -> Column:
    return is_subset(a.bitwiseAND(mask), b.bitwiseAND(mask))


def meaningful(split: Column, mask: Column) -> Column:
    """Whether a split has two taxa of the mask on either side."""
    return (F.bit_count(split.bitwiseAND(mask)) >= 2) & (F.bit_count(mask.bitwiseAND(F.bitwise_not(split))) >= 2)


def taxa_of(split: Column, n_taxa: int) -> Column:
    """The taxa of a split, from 1, as an array."""
    return F.filter(F.array(*[F.when(split.bitwiseAND(F.lit(1 << i).cast("long")) != 0, i + 1) for i in range(n_taxa)]), lambda x: x.isNotNull())


def split_of(taxa: Column) -> Column:
    """The split of an array of taxa from 1."""
    return F.aggregate(taxa, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.lit(1).cast("long") * F.pow(F.lit(2.0), t - 1).cast("long")))


def render_numbers(split: Column, n_taxa: int, full: int) -> Column:
    """``(1,2) | (3,4)``."""
    side = lambda x: F.concat(F.lit("("), F.array_join(F.transform(taxa_of(x, n_taxa), lambda t: t.cast("string")), ","), F.lit(")"))
    return F.concat(side(split), F.lit(" | "), side(complement(split, full)))


# Splits of more taxa than a BIGINT has bits are arrays of words, 62 taxa each, the first word first.
WORD = 62


def wide_split(bits: DataFrame, keys: list[str], taxon: str, n_taxa: int) -> DataFrame:
    """Rows of taxa from 1 to splits (keys, words), for any number of taxa."""
    at = F.col(taxon) - 1
    bit = F.expr(f"shiftleft(1L, cast((`{taxon}` - 1) % {WORD} AS INT))")
    words = [F.coalesce(F.bit_or(F.when(F.floor(at / WORD) == w, bit)), F.lit(0).cast("long")) for w in range(-(-n_taxa // WORD))]
    return bits.groupBy(*keys).agg(F.array(*words).alias("words"))


def wide_full(n_taxa: int) -> list[int]:
    return [(1 << min(WORD, n_taxa - WORD * w)) - 1 for w in range(-(-n_taxa // WORD))]


def wide_standardised(words: str, n_taxa: int) -> Column:
    """The side that has the first taxon."""
    full = F.array(*[F.lit(x).cast("long") for x in wide_full(n_taxa)])
    other = F.zip_with(words, full, lambda a, f: a.bitwiseXOR(f))
    return F.when(F.get(F.col(words), F.lit(0)).bitwiseAND(F.lit(1).cast("long")) == 0, other).otherwise(F.col(words))


def wide_count(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, x: a + F.bit_count(x))


def wide_compatible(a: str, b: str, n_taxa: int) -> Column:
    """Four-point test: one of the four intersections of the sides is empty."""
    full = F.array(*[F.lit(x).cast("long") for x in wide_full(n_taxa)])
    flip = lambda x: F.zip_with(x, full, lambda w, f: w.bitwiseXOR(f))
    empty = lambda x, y: ~F.exists(F.zip_with(x, y, lambda p, q: p.bitwiseAND(q)), lambda w: w != 0)
    x, y = F.col(a), F.col(b)
    return empty(x, y) | empty(x, flip(y)) | empty(flip(x), y) | empty(flip(x), flip(y))
