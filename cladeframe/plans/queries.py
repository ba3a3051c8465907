"""Registered queries of the matrix and tree operators over the relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encode import AMINO_ACIDS, genetic_code
from ..kernels.models import mk
from ..operators import frequencies, patterns, resample, running, splits, trees
from ..sources.views import FLAG_FULL, geo_nodes, priority_sites, returnflag_cells, returnflag_sites, table
from .scoring import ancestral_states, optimise_tree, score_trees, search_replicates, site_likelihoods

N_TAXA = 7
ALL = (1 << N_TAXA) - 1
c = F.col


def _collapsed(s: SparkSession, d: str) -> DataFrame:
    return patterns.collapse(returnflag_sites(s, d))


def q01_pattern_collapse(s, d):
    out = patterns.describe(_collapsed(s, d), FLAG_FULL)
    return out.select("pattern", "count", "first_site", "n_states", c("const_mask").cast("int").alias("const_mask"), "ptype")


def q02_pattern_types(s, d):
    out = patterns.describe(_collapsed(s, d), FLAG_FULL)
    return out.groupBy("ptype").agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def q03_state_distribution(s, d):
    out = patterns.describe(_collapsed(s, d), FLAG_FULL).groupBy("n_states").agg(F.sum("count").alias("sites"))
    return out.withColumn("share", F.round(c("sites") / F.sum("sites").over(Window.partitionBy(F.lit(0))), 6))


def q04_constant_sites(s, d):
    out = _collapsed(s, d).withColumn("const_mask", patterns.constant_mask("p", FLAG_FULL).cast("int")).where("const_mask <> 0")
    return out.groupBy("const_mask").agg(F.sum("count").alias("sites"))


def q05_missing_by_site(s, d):
    return returnflag_sites(s, d).select("site", F.size(F.filter("p", lambda x: x == FLAG_FULL)).alias("n_missing"))


def q06_base_freq_first_pass(s, d):
    return frequencies.first_pass(_collapsed(s, d), FLAG_FULL).select("state", F.round("freq", 6).alias("freq"))


def q07_pseudocount_freq(s, d):
    docs = table(s, d, "documents")
    text = F.coalesce(c("text"), F.lit(""))
    rest = lambda a: F.replace(F.replace(text, F.lit(a), F.lit("")), F.lit(a.lower()), F.lit(""))
    n = {a: F.sum(F.length(text) - F.length(rest(a))).alias(a) for a in AMINO_ACIDS}
    wide = docs.agg(*n.values())
    counts = wide.select(F.explode_outer(F.array(*[F.struct(F.lit(a).alias("state"), F.coalesce(c(a), F.lit(0)).alias("n")) for a in AMINO_ACIDS])).alias("x")).select("x.*")
    states = s.createDataFrame([(a,) for a in AMINO_ACIDS], "state string")
    return frequencies.with_pseudocount(counts, states).select("state", "n", F.round("freq", 6).alias("freq"))


def _base_usage(s, d):
    li = table(s, d, "lineitem")
    base = F.substring(F.lit("ACGT"), (c("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    return li.groupBy(((c("l_linenumber") - 1) % 3).alias("pos"), base.alias("base")).agg(F.count("*").alias("n"))


def q08_f1x4(s, d):
    out = frequencies.codon_frequencies(_base_usage(s, d), genetic_code(s), by_position=False)
    return out.select("codon", "aa", F.round("freq", 8).alias("freq"))


def q09_f3x4(s, d):
    out = frequencies.codon_frequencies(_base_usage(s, d), genetic_code(s), by_position=True)
    return out.select("codon", "aa", F.round("freq", 8).alias("freq"))


def q10_position_usage_grouping_sets(s, d):
    _base_usage(s, d).createOrReplaceTempView("_base_usage")
    return s.sql("SELECT pos, base, sum(n) AS n FROM _base_usage GROUP BY GROUPING SETS ((pos, base), (pos), ())")


def _codons(s, d):
    cu = table(s, d, "customer")
    parts = (c("c_custkey") % 4, c("c_nationkey") % 4, F.floor(F.abs("c_acctbal")) % 4)
    return cu.select("c_custkey", (parts[0] * 16 + parts[1] * 4 + parts[2]).cast("int").alias("codon_index"))


def q11_translate(s, d):
    out = _codons(s, d).join(F.broadcast(genetic_code(s, "vertmito")), "codon_index")
    return out.groupBy("codon", "aa").agg(F.count("*").alias("n"))


def q12_exclude_columns(s, d):
    out = table(s, d, "orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("site"))
    return patterns.collapse(returnflag_sites(s, d).join(out, "site", "left_anti")).select(patterns.pattern_text().alias("pattern"), "count")


def q13_charset_stride(s, d):
    sites = returnflag_sites(s, d).withColumn("subset", ((c("site") - 1) % 3 + 1).cast("int"))
    return patterns.collapse(sites, keys=["subset"]).groupBy("subset").agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def q14_split_by_nstates(s, d):
    out = patterns.describe(_collapsed(s, d), FLAG_FULL).where("n_states > 0")
    return out.groupBy("n_states").agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def _weighted_sites(s, d):
    w = table(s, d, "orders").groupBy(c("o_orderkey").alias("site")).agg((F.min("o_custkey") % 3).alias("w"))
    return returnflag_sites(s, d).join(w, "site", "left").withColumn("w", F.coalesce("w", F.lit(1)))


def q15_weighted_collapse(s, d):
    return patterns.collapse(_weighted_sites(s, d), weight=c("w")).select(patterns.pattern_text().alias("pattern"), "count")


def q16_uncollapse(s, d):
    sites = returnflag_sites(s, d)
    return patterns.uncollapse(sites, patterns.collapse(sites).select("p", "count")).select("site", patterns.pattern_text().alias("pattern"), "count")


def q17_adjacent_dedup(s, d):
    return patterns.drop_adjacent_equal(returnflag_sites(s, d)).select("site", patterns.pattern_text().alias("pattern"))


def _distances(s, d):
    return patterns.pair_distances(_collapsed(s, d), N_TAXA)


def q18_hamming_pairs(s, d):
    return _distances(s, d).withColumn("distance", F.round(c("different") / c("compared"), 6))


def _split_counts(s, d):
    p = _collapsed(s, d).select("count", splits.standardised(splits.state_split("p", 1), ALL).alias("split"))
    return p.groupBy("split").agg(F.sum("count").alias("n"))


def q19_splits_from_sites(s, d):
    return _split_counts(s, d).select("split", "n", splits.render(c("split"), N_TAXA).alias("picture"), F.bit_count("split").cast("int").alias("on_bits"))


def q20_split_compat(s, d):
    # At most 2**(taxa - 1) splits: a theta join of a proven bound.
    a = _split_counts(s, d).select("split")
    b = a.select(c("split").alias("other"))
    return a.join(F.broadcast(b), c("split") < c("other")).groupBy("split").agg(F.count("*").alias("pairs"), F.sum(splits.compatible(c("split"), c("other"), ALL).cast("long")).alias("compatible"))


def _constraints(s):
    return s.createDataFrame([(3,), (7,), (15,), (33,)], "split long")


def q21_constraint_semi(s, d):
    return splits.satisfying(_split_counts(s, d), _constraints(s))


def q22_constraint_anti(s, d):
    return splits.satisfying(_split_counts(s, d), _constraints(s), negative=True)


def q23_bit_algebra(s, d):
    k = F.lit(85).cast("long")
    x = c("split")
    return _split_counts(s, d).select("split", x.bitwiseOR(k).alias("union_"), x.bitwiseAND(k).alias("inter"), x.bitwiseAND(splits.complement(k, ALL)).alias("minus"), splits.complement(x.bitwiseXOR(k), ALL).alias("xnor"), F.bit_count("split").cast("int").alias("on_bits"), splits.is_subset(x, k).alias("subset"))


def q24_tree_closure(s, d):
    up = trees.ancestors(geo_nodes(s, d), 3)
    return up.groupBy(c("ancestor").alias("node")).agg((F.count("*") - 1).alias("descendants"), F.max("distance").alias("height"))


def q25_tree_splits(s, d):
    nodes = geo_nodes(s, d).where(F.substring("node", 1, 1).isin("r", "n"))
    tips = table(s, d, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("node"), F.expr("shiftleft(1L, n_nationkey)").alias("bit"))
    full = (1 << 25) - 1
    return trees.tip_splits(nodes, tips, 2).where("node <> 'root'").select("node", splits.standardised(c("split"), full).alias("split"), F.bit_count("split").cast("int").alias("tips"))


def q26_tree_length(s, d):
    cu, na = table(s, d, "customer"), table(s, d, "nation")
    out = cu.join(F.broadcast(na), c("c_nationkey") == c("n_nationkey"))
    return out.groupBy(c("n_regionkey").alias("tree_id")).agg(F.sum(F.round(F.abs("c_acctbal") * 100).cast("long")).alias("length_cents"), F.count("*").alias("branches"))


def q27_topology_equal(s, d):
    n = table(s, d, "nation")
    side = lambda key, name: n.groupBy(key.alias("g")).agg(F.bit_or(F.expr("shiftleft(1L, n_nationkey)")).alias("x")).select(splits.standardised(c("x"), (1 << 25) - 1).alias("split"), F.lit(1).alias(name))
    both = side(c("n_regionkey"), "a").join(side(c("n_nationkey") % 5, "b"), "split", "full")
    return both.agg(F.sum(F.when(c("a").isNotNull() & c("b").isNotNull(), 1).otherwise(0)).alias("shared"), F.sum(F.when(c("b").isNull(), 1).otherwise(0)).alias("only_a"), F.sum(F.when(c("a").isNull(), 1).otherwise(0)).alias("only_b"))


def q28_cumulative_selection(s, d):
    out = running.cumulative_selection(table(s, d, "events").select("user_id", "event_id", F.abs("value").alias("w")), "user_id", ["event_id"], "w")
    return out.select("user_id", "event_id", F.round("cumulative", 6).alias("cumulative"))


def _intervals(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("attempts"), F.sum(F.round(c("value") * 100).cast("long")).alias("gain"))


def q29_interval_window(s, d):
    return running.interval_window(_intervals(s, d), "event_type", "day", ["attempts", "gain"], 5)


def q30_adaptive_probs(s, d):
    out = running.adaptive_probabilities(running.interval_window(_intervals(s, d), "event_type", "day", ["attempts", "gain"], 5), "event_type", "day", "gain_last", "attempts_last", prior=0.5, floor=0.02)
    return out.select("event_type", "day", F.round("prob", 6).alias("prob"))


def q31_site_windows(s, d):
    w = running.site_windows(returnflag_sites(s, d), "site", 1000, 500)
    return patterns.collapse(w, keys=["window_id"]).groupBy("window_id").agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def q32_topk_suboptimal(s, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    out = table(s, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return out.select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


def q33_best_of_replicates(s, d):
    best = F.max(F.struct("o_totalprice", (-c("o_orderkey")).alias("k"))).alias("m")
    return table(s, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", c("m.o_totalprice").alias("best"), (-c("m.k")).alias("o_orderkey"))


def q34_best_so_far(s, d):
    return running.best_so_far(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value").select("user_id", "event_id", "best")


def q35_rank_individuals(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(s, d, "customer").select("c_custkey", "c_nationkey", F.rank().over(w).alias("rank"))


def q36_lcg_bootstrap(s, d):
    p = patterns.collapse(priority_sites(s, d)).select("first_site", "count")
    return resample.bootstrap_counts(p, resample.lcg_replicates(p, 10, 42), order="first_site")


def q37_swap_dedupe(s, d):
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("times"))
    return e.groupBy("event_type").agg(F.count("*").alias("unique_swaps"), F.sum("times").alias("total_swaps"), F.max("times").alias("most"))


def q38_cross_alignment_columns(s, d):
    sites = returnflag_sites(s, d)
    a = patterns.collapse(sites.where("site % 2 = 0")).select("p", c("count").alias("n_a"))
    b = patterns.collapse(sites.where("site % 2 = 1")).select("p", c("count").alias("n_b"))
    return a.join(b, "p").select(patterns.pattern_text().alias("pattern"), "n_a", "n_b")


def q39_jc_likelihood_pair(s, d):
    x = c("different") / c("compared")
    return _distances(s, d).select("taxon_a", "taxon_b", F.round(F.when(x < 0.75, -0.75 * F.log(1 - x * 4 / 3)), 6).alias("jc_distance"))


def q40_curve_grid(s, d):
    grid = s.createDataFrame([(0.01 * 2**k,) for k in range(8)], "t double")
    same = 0.25 + 0.75 * F.exp(-4 * c("t") / 3)
    lnl = (c("compared") - c("different")) * F.log(same / 4) + c("different") * F.log((1 - same) / 12)
    return _distances(s, d).join(F.broadcast(grid)).select("taxon_a", "taxon_b", F.round("t", 4).alias("t"), F.round(lnl, 4).alias("lnl"))


def q41_codon_stop_anti(s, d):
    stops = genetic_code(s).where("aa = '*'").select("codon_index")
    return _codons(s, d).join(F.broadcast(stops), "codon_index", "left_anti").groupBy("codon_index").agg(F.count("*").alias("n"))


def q42_event_day_windows(s, d):
    return _intervals(s, d).select("event_type", "day", "attempts", "gain")


def q43_charintwts_merge(s, d):
    old = _collapsed(s, d).select("p", "count")
    delta = _weighted_sites(s, d).where("w <> 1").groupBy("p").agg(F.sum(c("w") - 1).alias("delta"))
    out = old.join(delta, "p", "left").withColumn("count", c("count") + F.coalesce("delta", F.lit(0)))
    return out.where("count > 0").select(patterns.pattern_text().alias("pattern"), "count")


def q44_polymorphic_cells(s, d):
    return returnflag_cells(s, d).withColumn("states", F.bit_count("mask").cast("int")).groupBy("taxon", "states").agg(F.count("*").alias("cells"))


TAXA7, TAXA5 = [str(t) for t in range(1, 8)], [str(t) for t in range(1, 6)]
TREES7 = [(1, "(1:0.1,2:0.1,(3:0.1,(4:0.1,(5:0.1,(6:0.1,7:0.1):0.05):0.05):0.05):0.05);"), (2, "((1:0.2,7:0.2):0.1,(2:0.2,6:0.2):0.1,(3:0.2,(4:0.2,5:0.2):0.1):0.1);")]


def k01_score_tree(s, d):
    """Total and per-tree log-likelihoods of two stated trees under a three-state model."""
    out = score_trees(_collapsed(s, d), s.createDataFrame(TREES7, "tree_id int, newick string"), mk(3), TAXA7)
    return out.select("tree_id", F.round("lnl", 4).alias("lnl"))


def k02_newton_branch(s, d):
    """Branch lengths optimised by Newton steps, on the collapsed priority matrix."""
    counts = patterns.collapse(priority_sites(s, d)).select(F.lit(1).alias("rep"), "first_site", c("count").alias("n"), "p")
    return optimise_tree(counts, "(1:0.1,2:0.1,(3:0.1,(4:0.1,5:0.1):0.1):0.1);", mk(3), TAXA5)


def k03_bootstrap_search(s, d):
    """A tree search for each of four bootstrap replicates, of as many columns as the priority matrix has."""
    p = patterns.collapse(priority_sites(s, d))
    counts = resample.bootstrap_counts(p.select("first_site", "count"), resample.lcg_replicates(p, 4, 7), order="first_site")
    return search_replicates(p, counts, mk(3), TAXA5)


def k04_ancestral_states(s, d):
    """Most probable state of each pattern at each inner node of a stated tree."""
    out = ancestral_states(_collapsed(s, d), TREES7[0][1], mk(3), TAXA7)
    return out.select("node", "first_site", "best")


def k05_site_likelihoods(s, d):
    """Log-likelihood of each original site: scored once for each pattern, then restored."""
    sites = returnflag_sites(s, d)
    p = patterns.collapse(sites)
    lnl = site_likelihoods(p, s.createDataFrame(TREES7[:1], "tree_id int, newick string"), mk(3), TAXA7)
    return patterns.uncollapse(sites, p.join(lnl, "first_site").select("p", "lnl")).select("site", F.round("lnl", 6).alias("lnl"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue

    return {k: f for k, f in sorted(globals().items()) if k[0] in "qk" and k[1:3].isdigit()} | catalogue.queries()
