"""Registered text queries against DuckDB, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import oracle, registry
from oracle_check import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, name):
    assert differences(registry.queries()[name](spark, DATA), connect(DATA), oracle.SQL[name]) == ""


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    kept = {r[0] for r in p.decontamination(spark, docs, DATA).select("doc_id").collect()}
    hit = {r[0] for r in registry.queries()["op3_benchmark_decontamination"](spark, DATA).where("contaminated").select("doc_id").collect()}
    assert hit and kept == {r[0] for r in docs.select("doc_id").collect()} - hit
    assert p.line_dedup(spark, docs, DATA).columns == p.language_id(spark, docs, DATA).columns == docs.columns


def test_copies_leave_one_document(spark):
    import corpus_pipeline as p

    lines = [[f"w{i}x{j}x{k}" for k in range(12)] for i in range(4) for j in range(10)]
    rows = []
    for i in range(4):
        mine = lines[10 * i : 10 * i + 10]
        text = "\n".join(map(" ".join, mine))
        changed = [list(x) for x in mine]
        changed[5][6] = "changed"
        rows += [(10 * i, text), (10 * i + 1, text), (10 * i + 2, "\n".join(map(" ".join, changed))), (10 * i + 3, text + "\n\n")]
        rows.append((10 * i + 4, f"own {i}\n" + "\n".join(f"own {i} {k} of this" for k in range(60)) + "\n" + "\n".join(map(" ".join, mine[:4]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    cut = p.line_dedup(spark, docs, DATA)
    left = {r.doc_id: r for r in p.jaccard_join(spark, cut, DATA).collect()}
    assert sorted(left) == sorted(10 * i + k for i in range(4) for k in (0, 4))
    assert all(left[10 * i].text == rows[5 * i][1] for i in range(4))
    assert all("w" + str(i) not in left[10 * i + 4].text and left[10 * i + 4].text.count("\n") == 60 for i in range(4))
    assert all(r.n_chars == len(r.text) for r in left.values())
