"""Further registered queries: encodings, subsets, split algebra, tree surgery, resampling, populations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encode import GENETIC_CODES, amino_index, genetic_code, mask_char, nucleotide_mask
from ..operators import frequencies, patterns, population, resample, running, splits, trees
from ..sources.views import FLAG_FULL, geo_nodes, priority_sites, returnflag_cells, returnflag_sites, table

N_TAXA, ALL = 7, 127
c = F.col


def _collapsed(s, d):
    return patterns.collapse(returnflag_sites(s, d))


def q45_pattern_order(s, d):
    out = patterns.in_pattern_order(_collapsed(s, d), FLAG_FULL)
    return out.select("position", patterns.pattern_text().alias("pattern"), "count")


def q46_strip_missing(s, d):
    p = patterns.drop_taxa(_collapsed(s, d), [1, 2, 3])
    kept = patterns.without_missing(p, FLAG_FULL)
    return kept.agg(F.sum("count").alias("sites"), F.count_distinct("p").alias("patterns"))


def q47_drop_taxa(s, d):
    return patterns.collapse(patterns.drop_taxa(returnflag_sites(s, d), [2, 5])).select(patterns.pattern_text().alias("pattern"), "count")


def q48_partly_ambiguous(s, d):
    return patterns.partly_ambiguous(returnflag_cells(s, d), FLAG_FULL)


def q49_dummy_root(s, d):
    return patterns.collapse(patterns.add_taxon(returnflag_sites(s, d), FLAG_FULL)).select(patterns.pattern_text().alias("pattern"), "count")


def q50_iupac_encode(s, d):
    char = F.substring(F.lit("ACGTMRWSYKVHDBN-?"), (c("l_partkey") % 17 + 1).cast("int"), F.lit(1))
    out = table(s, d, "lineitem").select(char.alias("char")).withColumn("mask", nucleotide_mask(c("char")))
    return out.groupBy("char", "mask", mask_char(c("mask")).alias("back")).agg(F.count("*").alias("n"))


def q51_amino_encode(s, d):
    letter = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWYX*-"), (c("p_partkey") % 23 + 1).cast("int"), F.lit(1))
    return table(s, d, "part").select(letter.alias("letter")).groupBy("letter", amino_index(c("letter")).cast("int").alias("state")).agg(F.count("*").alias("n"))


#: A character partition: first and second columns of every three up to 3000, and all after them.
SUBSETS = [("first", 1, 3000, 3), ("second", 2, 3000, 3), ("rest", 3001, 1 << 40, 1)]


def _subsets(s):
    return s.createDataFrame(SUBSETS, "subset string, first long, last long, step long")


def q52_charpartition(s, d):
    sites = patterns.in_subsets(returnflag_sites(s, d), _subsets(s))
    return patterns.collapse(sites, keys=["subset"]).groupBy("subset").agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def q53_codons_of_sites(s, d):
    coded = patterns.codons(returnflag_cells(s, d), FLAG_FULL)
    out = patterns.translated(coded, genetic_code(s), ignore_stops=True)
    return out.groupBy("taxon", "aa").agg(F.count("*").alias("n"))


def q54_genetic_codes(s, d):
    out = None
    for name in GENETIC_CODES:
        for two in (False, True):
            code = genetic_code(s, name, two).select(F.lit(name).alias("code"), F.lit(two).alias("two_serines"), "aa")
            out = code if out is None else out.unionByName(code)
    return out.groupBy("code", "two_serines", "aa").agg(F.count("*").alias("codons"))


def q55_base_freq_em(s, d):
    got = frequencies.refined(_collapsed(s, d), FLAG_FULL)
    return s.createDataFrame([(k, round(v, 5)) for k, v in got.items()], "state int, freq double")


def q56_subset_models(s, d):
    # Data of each subset, its model and its rate meet in one small table.
    models = s.createDataFrame([("first", 1, 0.5), ("second", 1, 1.0), ("rest", 2, 2.0)], "subset string, model_id int, rate double")
    data = patterns.collapse(patterns.in_subsets(returnflag_sites(s, d), _subsets(s)), keys=["subset"])
    x, y = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    known = data.where((F.bit_count(x) == 1) & (F.bit_count(y) == 1)).join(F.broadcast(models), "subset")
    same = F.lit(1 / 3) + F.lit(2 / 3) * F.exp(-1.5 * 0.1 * c("rate"))
    lnl = F.when(x == y, F.ln(same / 3)).otherwise(F.ln((1 - same) / 6))
    return known.groupBy("model_id").agg(F.round(F.sum(c("count") * lnl), 4).alias("lnl"), F.sum("count").alias("sites"))


def _splits(s, d):
    return _collapsed(s, d).select(splits.standardised(splits.state_split("p", 1), ALL).alias("split")).distinct()


MASKED = [(3, 31), (7, 127), (9, 107), (33, 99)]


def q57_masked_splits(s, d):
    k = s.createDataFrame(MASKED, "other long, mask long")
    out = _splits(s, d).join(F.broadcast(k))
    joint = c("mask").bitwiseAND(F.lit(119).cast("long"))
    return out.select("split", "other", splits.equal_within(c("split"), c("other"), c("mask")).alias("same"), splits.subset_within(c("split"), c("other"), c("mask")).alias("subset"), joint.alias("joint"), splits.meaningful(c("split"), joint).alias("meaningful"))


def q58_split_taxa(s, d):
    x, taxa = c("split"), splits.taxa_of(c("split"), N_TAXA)
    absent = splits.taxa_of(splits.complement(x, ALL), N_TAXA)
    out = _splits(s, d).select("split", F.array_join(F.transform(taxa, lambda t: t.cast("string")), ",").alias("taxa"), F.get(taxa, F.lit(0)).alias("first_present"), F.get(absent, F.lit(0)).alias("first_absent"), splits.split_of(taxa).alias("back"), splits.render_numbers(x, N_TAXA, ALL).alias("picture"))
    # At most 2**(taxa - 1) splits are put in order.
    return out.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("split")))


def q59_constraint_pairs(s, d):
    k = s.createDataFrame([(x,) for x in (3, 5, 7, 15, 33, 97)], "split long")
    return k.join(k.select(c("split").alias("other")), c("split") < c("other")).select("split", "other", splits.compatible(c("split"), c("other"), ALL).alias("compatible"))


def _nation_tips(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("node"), F.expr("shiftleft(1L, n_nationkey)").alias("bit"))


def _upper(s, d):
    return geo_nodes(s, d).where(F.substring("node", 1, 1) == "n").unionByName(geo_nodes(s, d).where(F.substring("node", 1, 1) == "r"))


def q60_splits_after_move(s, d):
    nodes, full = _upper(s, d), (1 << 25) - 1
    moved = nodes.withColumn("parent", F.when(c("node") == "n6", "r0").otherwise(c("parent")))
    side = lambda x, name: trees.tip_splits(x, _nation_tips(s, d), 2).where("node LIKE 'r%'").select("node", splits.standardised(c("split"), full).alias(name))
    return side(nodes, "before").join(side(moved, "after"), "node", "full").where("NOT before <=> after")


def q61_tip_distances(s, d):
    return trees.distances(_upper(s, d), _nation_tips(s, d), 2)


def q62_collapse_short(s, d):
    short = table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("node"))
    out = trees.collapse_short(geo_nodes(s, d), short, 3)
    return out.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))


def q63_reroot(s, d):
    return trees.rerooted(_upper(s, d), "n7", 2).select("node", "parent")


def q64_nearest_tips(s, d):
    return trees.nearest_tips(geo_nodes(s, d), 3)


def q65_reconnections(s, d):
    nodes = _upper(s, d)
    found = trees.reconnections(nodes, nodes.where("node IN ('n1', 'n2', 'n3')"), 2, 2)
    nth = Window.partitionBy("cut").orderBy("distance", "node")
    return found.withColumn("nth", F.row_number().over(nth))


def q66_window_frequencies(s, d):
    w = running.site_windows(returnflag_sites(s, d), "site", 2000, 0)
    cells = patterns.collapse(w, keys=["window_id"]).select("window_id", "count", F.explode("p").alias("mask")).where(F.bit_count("mask") == 1)
    n = cells.groupBy("window_id", "mask").agg(F.sum("count").alias("n"))
    return n.select("window_id", c("mask").alias("state"), "n", F.round(c("n") / F.sum("n").over(Window.partitionBy("window_id")), 6).alias("freq"))


def q67_random_individuals(s, d):
    cu = table(s, d, "customer")
    return cu.select("c_custkey", resample.shuffled(cu, c("c_custkey"), 42).alias("h")).orderBy("h", "c_custkey").limit(50)


def q68_subset_union(s, d):
    sites = returnflag_sites(s, d)
    parts = patterns.collapse(sites.where("site % 2 = 0")).unionByName(patterns.collapse(sites.where("site % 2 = 1")))
    return parts.groupBy(patterns.pattern_text().alias("pattern")).agg(F.sum("count").alias("count"), F.min("first_site").alias("first_site"))


def q69_distinct_topologies(s, d):
    bit = F.expr("shiftleft(1L, cast(substring(o_orderpriority, 1, 1) AS INT) - 1)")
    sp = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(splits.standardised(F.bit_or(bit), 31).alias("split"))
    out = population.distinct_topologies(sp, "o_custkey", "split")
    return out.select(F.array_join(F.transform("splits", lambda x: x.cast("string")), ",").alias("splits"), "n_trees", "first_tree")


def q70_ratchet(s, d):
    p = resample.ratchet(_collapsed(s, d), 42)
    return p.select("first_site", "orig_count", "count")


def q71_reset_counts(s, d):
    return resample.reset(resample.ratchet(_collapsed(s, d), 42)).select("first_site", "count")


def q72_proportional_resample(s, d):
    sites = priority_sites(s, d).withColumn("subset", (c("site") % 2).cast("int"))
    p = patterns.collapse(sites, keys=["subset"])
    draws = resample.lcg_replicates(p, 4, 7, proportion=0.5, keys=["subset"])
    return resample.bootstrap_counts(p, draws, order="first_site", keys=["subset"])


def q73_unconditioned(s, d):
    constant = s.createDataFrame([([m] * N_TAXA,) for m in (1, 2, 4)], "p array<int>")
    return resample.without_conditioned(_collapsed(s, d), constant).agg(F.sum("count").alias("sites"), F.count("*").alias("patterns"))


def q74_exponential(s, d):
    u = resample.uniform(c("event_id"), 11)
    return table(s, d, "events").select("event_id", F.round(u, 9).alias("u"), F.round(resample.exponential(u, 10.0), 6).alias("x"))


def q75_shuffle(s, d):
    cu = table(s, d, "customer")
    out = cu.select("c_custkey", "c_nationkey", resample.shuffled(cu, c("c_custkey"), 7).alias("h"))
    return out.select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("h")).alias("place"))


def _selected(s, d):
    cu = table(s, d, "customer").select("c_nationkey", "c_custkey", (c("c_acctbal") / 1000).alias("lnl"))
    return population.selection(cu, "c_nationkey", "lnl", ["c_custkey"], intensity=0.5, holdover=1)


def q76_selection(s, d):
    return _selected(s, d).select("c_nationkey", "c_custkey", "rank", F.round("prob", 6).alias("prob"), F.round("cumulative", 6).alias("cumulative"), "kept")


def q77_mutation_kinds(s, d):
    kinds = table(s, d, "events").select((c("event_id") % 256).cast("int").alias("kinds"))
    return population.kind_counts(kinds, "kinds")


def q78_population_edits(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    four = table(s, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("c_mktsegment", "rank", "c_custkey")
    return population.swapped(population.resized(four, "c_mktsegment", 6), "c_mktsegment", "BUILDING", "MACHINERY", 2)


def q79_progress(s, d):
    out = population.progress(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", patience=5, least=0.01)
    return out.select("user_id", "event_id", F.round("fraction", 6).alias("fraction"), "best", "improved", "done")


def q80_column_ranges(s, d):
    constant = returnflag_sites(s, d).where(patterns.constant_mask("p", FLAG_FULL) != 0)
    return patterns.column_ranges(constant)


def q81_taxon_numbers(s, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    names = table(s, d, "nation").select("n_regionkey", "n_name", F.row_number().over(w).alias("number"))
    twice = table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
    return names.crossJoin(twice.agg(F.count("*").alias("names_twice")))


def q82_parents(s, d):
    draws = table(s, d, "nation").select(c("n_nationkey").alias("c_nationkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("child"))
    draws = draws.withColumn("u", resample.uniform(c("c_nationkey") * 4 + c("child"), 5))
    return population.parents(_selected(s, d), "c_nationkey", draws)


def q83_wide_splits(s, d):
    """Splits of 500 taxa, in words: the vectors whose sign is positive, by dimension."""
    e = table(s, d, "embeddings").select((c("vec_id") % 500 + 1).alias("taxon"), F.posexplode("embedding").alias("dim", "x")).where("x > 0")
    w = splits.wide_split(e, ["dim"], "taxon", 500).withColumn("words", splits.wide_standardised("words", 500))
    return w.select("dim", F.array_join(F.transform("words", lambda x: x.cast("string")), ",").alias("words"), splits.wide_count(c("words")).alias("on_bits"))


def q84_tree_lengths_scaled(s, d):
    """Branch lengths scaled and mutated by a factor for each branch, and the tree's length before and after."""
    u = resample.uniform(c("c_custkey"), 3)
    b = table(s, d, "customer").select("c_nationkey", F.abs("c_acctbal").alias("blen"), u.alias("u"))
    after = F.greatest(F.lit(1e-8), c("blen") * F.exp(0.5 * (c("u") - 0.5)))
    return b.groupBy("c_nationkey").agg(F.round(F.sum("blen"), 4).alias("before"), F.round(F.sum(after), 4).alias("after"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
