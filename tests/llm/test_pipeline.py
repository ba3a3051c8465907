"""The pipeline, stage by stage and as a whole, against brute force on the smallest tables, and on empty ones."""

import re
from collections import defaultdict

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as p
from cladeframe.llm.language_id import held_out, identify, train
from cladeframe.llm.registry import tokenizer_path
from test_text_operators import BLANK, contaminated, words_of

DATA = "/root/testdata/sf0.001"
BREAK = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def least_of_groups(texts):
    """Ids that stay where those linked by 5-word shingles leave the least."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t, BLANK)
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders, root = defaultdict(list), {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    near = {(a, b) for x in holders.values() for a in x for b in x if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i for i in texts if top(i) == i}


def without_runs(texts):
    """Texts without the lines of runs of two or more that stand at an earlier place."""
    places, units = defaultdict(list), {i: re.split(BREAK, t) for i, t in texts.items()}
    for i in sorted(units):
        u = units[i]
        for at, x in enumerate(u):
            if at + 1 < len(u):
                places[x + "\n" + u[at + 1].split("\n")[0], 2].append((i, at))
            if "\n" in x and re.search(BLANK, x):
                places[x, 1].append((i, at))
    gone = defaultdict(set)
    for (_, n), found in places.items():
        for i, at in sorted(found)[1:]:
            gone[i] |= set(range(at, at + n))
    out = {}
    for i, u in units.items():
        left = "\n".join(x for at, x in enumerate(u) if at not in gone[i])
        if not gone[i]:
            out[i] = texts[i]
        elif re.search(BLANK, left):
            out[i] = left
    return out


def test_stages_and_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = lambda d: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    seen = identify(docs, train(docs.where(~held_out(F.col("doc_id")))))
    first = p.language_id(spark, docs, DATA)
    assert set(texts(first)) == {r.doc_id for r in seen.where((F.col("lang_pred") != "und") & (F.col("score") >= p.LEAST_SCORE)).collect()}
    known = texts(first)
    stay = least_of_groups(known)
    cut = without_runs({i: known[i] for i in stay})
    second = p.line_dedup(spark, first, DATA)
    assert texts(second) == cut and second.columns == docs.columns
    third = p.jaccard_join(spark, second, DATA)
    assert set(texts(third)) == least_of_groups(cut)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    left = {i: cut[i] for i in texts(third)}
    bad = {r[0] for r in contaminated(list(left.items()), items) if r[-1]}
    clean = {i for i in left if i not in bad}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in p.run(spark, DATA).collect()}
    assert set(got) == clean and all(got[i] == sp.encode(left[i]) for i in got)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_and_namesakes(spark):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"thing{i}" for i in range(40))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").where(F.length("text") > 100).first().text
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (1, other, "d"), (None, bench, "e"), (2, bench + " more", "f"), (None, other + " x", "g"), (3, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = {r.row for r in p.jaccard_join(spark, docs, DATA).collect()}
    assert len(kept & {"a", "b"}) == 1 and "c" not in kept and "d" in kept and "g" not in kept and "h" in kept
    assert {r.row for r in p.decontamination(spark, docs, DATA).collect()} == {"a", "b", "c", "d", "g", "h"}
