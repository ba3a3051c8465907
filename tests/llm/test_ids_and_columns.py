"""All ten operators with ids of any type, null ids, clashing column names, a very long text and an empty table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, passage_dedup, piece_codec, quality_rules, sharding, token_count
from cladeframe.llm.registry import tokenizer_path

LONG = " ".join(f"word{i}" for i in range(150_000)) + "\nlast line of it"
SHARED = " ".join(f"shared{i}" for i in range(60))
TEXTS = ["some words of the first text here\nand a line", SHARED, "x " + SHARED, None, "", LONG, "Some words of the first text here\nand a line"]
EXTRA = ("_id", "_text", "_hash", "_gone", "n_lines", "row", "whole", "node", "region", "part", "component", "at")


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(SHARED.split()[5:40]))], "item_id long, text string")


OPERATORS = {
    "license_scan": lambda s, d: license_scan.scan_licenses(d),
    "passage_dedup": lambda s, d: passage_dedup.find_repeated_passages(d),
    "decontaminate": lambda s, d: decontaminate.find_overlaps(d, benchmark(s)),
    "quality_rules": lambda s, d: quality_rules.quality_filter(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "sharding": lambda s, d: sharding.shard_documents(d, 4),
    "language_id": lambda s, d: language_id.identify_languages(d),
    "jaccard_join": lambda s, d: jaccard_join.link_sets(d),
    "piece_codec": lambda s, d: piece_codec.encode_pieces(d, tokenizer_path("piece_bpe_32k.model")),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "token_count": lambda s, d: token_count.count_tokens(d, tokenizer_path("byte_bpe_50k.json")),
}
IDS = {"long": [(1 << 60) + 1, 1 << 60, (1 << 60) + 2, None, 5, None, (1 << 60) + 1], "string": ["a", "B", "ä", None, "", None, "a"]}


@pytest.mark.parametrize("kind", IDS)
@pytest.mark.parametrize("name", OPERATORS)
def test_ids(spark, name, kind):
    rows = [(i, t, "en", *["keep"] * len(EXTRA)) for i, t in zip(IDS[kind], TEXTS)]
    schema = f"doc_id {kind}, text string, lang string, " + ", ".join(f"{x} string" for x in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    got = OPERATORS[name](spark, docs).collect()
    ids = Counter(r.doc_id for r in got)
    if name == "passage_dedup":
        assert ids == Counter([IDS[kind][1], IDS[kind][2]]) and {r.class_id for r in got} == {min(IDS[kind][1:3])}
    else:
        assert ids == Counter(IDS[kind])
    if name == "line_dedup":
        assert all(r[x] == "keep" for r in got for x in EXTRA if x != "n_lines")
        assert {r.text for r in got} == set(TEXTS) and max(r.n_lines for r in got) == 2
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_letters_are_those_of_unicode():
    assert [bool(language_id.LETTER.search(x)) for x in ("²", "½", "①", "Ⅷ", "_", "7", "é", "日", "ß")] == [False] * 6 + [True] * 3


def test_reversed_words_are_no_license(spark):
    words = "this source code form is subject to the terms of the mozilla public license".split()
    pairs = [words[i : i + 2] for i in range(0, 14, 2)]
    rows = [(1, " ".join(words)), (2, " ".join(w for p in reversed(pairs) for w in p)), (3, " ".join(words[:6] + ["strictly"] + words[6:]))]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mpl", 2: "", 3: "mpl"}


def test_a_filter_on_overlaps_is_planned_at_once(spark):
    import time

    docs = spark.createDataFrame([(1, SHARED), (2, "none of it")], "doc_id long, text string")
    began = time.monotonic()
    assert [r.doc_id for r in decontaminate.find_overlaps(docs, benchmark(spark)).where("contaminated").select("doc_id").collect()] == [1]
    assert time.monotonic() - began < 20


def test_rules_are_learned_from_labelled_documents(spark):
    good = [(f"g{i}", " ".join(f"w{i}x{j}" for j in range(40)) + ".") for i in range(120)]
    bad = [(f"b{i}", " ".join(f"v{i}x{j} !!!" for j in range(40))) for i in range(120)]
    docs = spark.createDataFrame(good + bad + [("n", None)], "doc_id string, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(None, 0), ("g1", None)], "doc_id string, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_filter(docs, labels).collect()}
    held_out = [got[i] for i, _ in good[1::2]] + [not got[i] for i, _ in bad[1::2]]
    assert sum(held_out) >= 0.95 * len(held_out) and got["n"] is False


def test_ftrl_step_is_the_published_one():
    """One row, one pass: w = 0 before, so z and n hold the gradient, and w follows in closed form."""
    import numpy as np

    s = language_id.Settings(epochs=1)
    at, value = np.array([0, 3, 4]), np.array([0.5, 2.0, 1.0])
    w, bias = language_id._fit([(at, value, 1)], 3, 4, s)
    grad = value[:, None] * (np.full(3, 1 / 3) - np.array([0, 1, 0]))
    want = np.where(np.abs(grad) <= s.l1, 0, -(grad - np.sign(grad) * s.l1) / ((s.beta + np.abs(grad)) / s.alpha + s.l2))
    assert np.allclose(np.vstack([w[[0, 3]], bias]), want) and not w[[1, 2]].any()
