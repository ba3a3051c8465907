"""Tokenization shared by the text operators, as built-in column expressions.

Arrays made here are exploded with ``explode_outer``: for ``explode`` the optimizer adds a filter on the
array's size below the projections that make it, which would evaluate all of them again and again.
For the same reason no filter stands on such an array: it would be pushed below them.
Inside a lambda elements are taken with ``get``; ``slice`` would copy the whole array for each element.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is not a word character for alphanumeric words: ASCII except 0-9 and a-z.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of blank-delimited words.
BLANK = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the cheaper ``lower``, which is the same for them."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def alnum_words(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def blank_words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: str, k: int) -> Column:
    """64-bit hashes of the k-grams of a column of hashes; empty if it has fewer than k.

    The hashes must be a column of their own: an expression would be evaluated for each gram.
    """
    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))
