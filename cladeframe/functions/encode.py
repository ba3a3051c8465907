"""Encodings of characters as states: lookup tables and column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: IUPAC nucleotide codes as bit masks, A=1 C=2 G=4 T=8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "S": 6, "V": 7, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15, "-": 15, "?": 15}
#: One-letter amino acid codes in alphabetical order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Public genetic code tables 1, 2 and 5, codons in the order T, C, A, G.
GENETIC_CODES = {
    "standard": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "vertmito": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    "invertmito": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
}
BASES = "ACGT"


def nucleotide_mask(char: Column) -> Column:
    """State mask of a nucleotide character, of either case; another character raises an error."""
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    got = table[F.upper(char)]
    return F.when(got.isNull() & char.isNotNull(), F.raise_error(F.concat(F.lit("unknown nucleotide "), char)).cast("int")).otherwise(got)


def mask_char(mask: Column) -> Column:
    """The character of a state mask; the full mask is the gap."""
    back = {v: k for k, v in IUPAC.items() if k not in "UN?-"} | {15: "-"}
    return F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[mask]


def amino_index(char: Column) -> Column:
    """Index of an amino acid letter; null for gaps and ambiguous letters."""
    at = F.position(F.upper(char), F.lit(AMINO_ACIDS))
    return F.when((at > 0) & (F.length(char) == 1), at - 1)


def genetic_code(spark: SparkSession, name: str = "standard", two_serines: bool = False) -> DataFrame:
    """64 rows (codon index 16 a + 4 b + c with A, C, G, T as 0..3, codon, amino acid); a stop is ``*``.
    With ``two_serines`` the serines AGC and AGT are the letter ``Z``."""
    letters = dict(zip(("".join(x) for x in product("TCAG", repeat=3)), GENETIC_CODES[name]))
    rows = []
    for i, codon in enumerate("".join(x) for x in product(BASES, repeat=3)):
        aa = letters[codon]
        rows.append((i, codon, "Z" if two_serines and aa == "S" and codon.startswith("AG") else aa))
    return spark.createDataFrame(rows, "codon_index int, codon string, aa string")
