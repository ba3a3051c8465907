"""Token counts by a two-tier map-side lookup; no pre-token is ever shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

#: The byte-level pre-token pattern, a fixed value of the tokenizer's format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Of a text of the sample so many characters are read.
SAMPLE_CHARS = 100_000


def _frequent(docs: DataFrame, id_col: str, text_col: str, tokenizer, specials: list[str], entries: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of texts, picked by hash over all partitions, of long
    texts the first SAMPLE_CHARS. It only saves time: what it lacks is encoded."""
    from collections import Counter

    import regex

    pattern, seen = regex.compile(PRE_TOKEN), Counter()
    some = docs.where(F.col(text_col).isNotNull())
    # About sample_rows of them; the limit only holds where many rows are equal.
    one_in = max(1, some.count() // sample_rows)
    picked = some.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(one_in)) == 0).select(F.substring(text_col, 1, SAMPLE_CHARS)).limit(2 * sample_rows)
    for (text,) in picked.collect():
        for part in _apart(text, specials):
            seen.update(pattern.findall(part))
    words = [w for w, _ in seen.most_common(entries)]
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False))}


def _apart(text: str, specials: list[str]) -> list[str]:
    for s in specials:
        if s in text:
            import regex

            return regex.split("|".join(map(regex.escape, specials)), text)
    return [text]


def count_tokens(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_entries: int = 50_000, sample_rows: int = 2_000, cache_entries: int = 500_000) -> DataFrame:
    """Tokens of every whole text as a byte-level BPE tokenizer file gives them, without added special tokens.

    Tier one is a broadcast table of at most ``table_entries`` frequent pre-tokens and their
    lengths, taken from about ``sample_rows`` texts of all partitions. Tier two encodes what the table lacks, once for each
    worker, and keeps at most ``cache_entries`` lengths; the cache is emptied when full. Neither
    bound changes a result. Special strings inside a text count as one token each, as the
    tokenizer's default has it.

    Null text counts as empty: 0 bytes and 0 tokens. Repeated rows give repeated results, and an
    empty table gives no rows. Other columns of the input are not carried.
    """
    from pathlib import Path

    from tokenizers import Tokenizer

    raw = Path(tokenizer_json).read_text()
    tokenizer = Tokenizer.from_str(raw)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((raw, specials, _frequent(docs, id_col, text_col, tokenizer, specials, table_entries, sample_rows)))

    def make():
        import regex
        from tokenizers import Tokenizer

        source, special, table = shared.value
        model = Tokenizer.from_str(source)
        find, cut = regex.compile(PRE_TOKEN).findall, regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        is_special, missed = set(special), {}

        class Lengths(dict):
            def __missing__(self, word: str) -> int:
                n = missed.get(word)
                if n is None:
                    if len(missed) >= cache_entries:
                        missed.clear()
                    n = missed[word] = len(model.encode(word, add_special_tokens=False).ids)
                return n

        of = Lengths(table).__getitem__

        def count(text: str) -> int:
            if cut is None or not any(s in text for s in special):
                return sum(map(of, find(text)))
            return sum(1 if part in is_special else sum(map(of, find(part))) for part in cut.split(text))

        def lengths(texts: list) -> dict:
            texts = [t or "" for t in texts]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count(t) for t in texts]}

        return lengths

    out = map_texts(docs, id_col, text_col, make, {"n_bytes": "long", "n_tokens": "long"})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
