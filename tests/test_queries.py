"""Every query of the matrix and tree operators against DuckDB."""

import pytest

from cladeframe.plans import queries, sql
from oracle_check import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(queries.queries()) - set(sql.SQL) <= {"k02_newton_branch", "k03_bootstrap_search", "k04_ancestral_states"} and set(sql.SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query(spark, con, name):
    assert differences(queries.queries()[name](spark, DATA), con, sql.SQL[name]) == ""


def test_scores_and_sites_agree(spark):
    total = {r["tree_id"]: r["lnl"] for r in queries.k01_score_tree(spark, DATA).collect()}
    sites = [r["lnl"] for r in queries.k05_site_likelihoods(spark, DATA).collect()]
    assert len(sites) == 1473 and sum(sites) == pytest.approx(total[1], abs=0.01)


def test_bootstrap_search_and_ancestors(spark):
    found = queries.k03_bootstrap_search(spark, DATA).collect()
    assert sorted(r["rep"] for r in found) == [1, 2, 3, 4] and all(r["lnl"] < 0 for r in found)
    (best,) = queries.k02_newton_branch(spark, DATA).collect()
    assert best["lnl"] < 0
    assert {r["best"] for r in queries.k04_ancestral_states(spark, DATA).collect()} <= {0, 1, 2}


def test_previous_in_order_is_lag(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cladeframe.operators.patterns import previous_in_order

    d = spark.range(0, 5000, 7).select(F.col("id").alias("site"), (F.col("id") % 5).alias("p"))
    want = d.withColumn("prev", F.lag("p").over(Window.orderBy("site")))
    assert sorted(previous_in_order(d, "site", "p", "prev", block=64).collect()) == sorted(want.collect())


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from cladeframe.streaming.intervals import interval_statistics, read_events

    q = interval_statistics(read_events(spark, DATA)).writeStream.format("memory").queryName("intervals").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("intervals").collect()}
    batch = {tuple(r) for r in interval_statistics(spark.read.parquet(DATA + "/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got and got <= batch and len(batch) - len(got) <= 10


def test_replicates_are_whole(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cladeframe.operators import resample

    p = spark.createDataFrame([(1, 5000), (2, 4321)], "first_site long, count long")
    got = sorted(tuple(r) for r in resample.lcg_replicates(p, 2, 7).collect())
    assert got == [(r, n, (r + 7) * pow(16807, n, 2**31 - 1) % (2**31 - 1)) for r in (1, 2) for n in range(1, 9322)]
    seen = []
    monkeypatch.setattr(queries, "search_replicates", lambda p, counts, *a: seen.append((p, counts)))
    queries.k03_bootstrap_search(spark, DATA)
    sites = seen[0][0].agg(F.sum("count")).first()[0]
    assert {r["n"] for r in seen[0][1].groupBy("rep").agg(F.sum("n").alias("n")).collect()} == {sites}


def test_draws_are_not_broadcast(spark):
    from cladeframe.operators import resample

    p = spark.createDataFrame([(1, 5000), (2, 4321)], "first_site long, count long")
    out = resample.bootstrap_counts(p, resample.lcg_replicates(p, 2, 7), order="first_site")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [bucket" in plan
    assert out.groupBy("rep").sum("n").collect() and {r[1] for r in out.groupBy("rep").sum("n").collect()} == {9321}
