"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from itertools import product

from ..functions.encode import AMINO_ACIDS, BASES, GENETIC_CODES

_T = range(1, 8)
_P = [f"p{t}" for t in _T]
_MASK = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END"
_SITES = f"sites AS (SELECT l_orderkey AS site, {', '.join(f'coalesce(bit_or(CASE WHEN l_linenumber = {t} THEN {_MASK} END), 7)::INT AS p{t}' for t in _T)} FROM lineitem GROUP BY l_orderkey)"
_TEXT = "concat_ws(',', " + ", ".join(_P) + ")"
_AND = "(" + " & ".join(_P) + ")"
_OBS = "(" + " | ".join(f"(CASE WHEN bit_count({p}) = 1 THEN {p} ELSE 0 END)" for p in _P) + ")"
_TWICE = " + ".join("(CASE WHEN " + " + ".join(f"(CASE WHEN {p} = {s} THEN 1 ELSE 0 END)" for p in _P) + " >= 2 THEN 1 ELSE 0 END)" for s in (1, 2, 4))
_TYPE = f"CASE WHEN {_AND} = 7 THEN 'missing' WHEN {_AND} <> 0 THEN 'constant' WHEN {_TWICE} >= 2 THEN 'informative' ELSE 'uninformative' END"
_COLS = ", ".join(_P)
_PATS = f"pats AS (SELECT {_COLS}, count(*) AS n, min(site) AS first_site FROM sites GROUP BY {_COLS})"
_BASE = f"WITH {_SITES}, {_PATS} "
_SPLIT = "(" + " + ".join(f"(CASE WHEN p{t} = 1 THEN {1 << (t - 1)} ELSE 0 END)" for t in _T) + ")::BIGINT"
_SPLITS = f"raw AS (SELECT {_SPLIT} AS x, n FROM pats), splits AS (SELECT CASE WHEN x & 1 = 0 THEN xor(x, 127::BIGINT) ELSE x END AS split, sum(n)::BIGINT AS n FROM raw GROUP BY 1)"
_PAIRS = " UNION ALL ".join(f"SELECT {a} AS taxon_a, {b} AS taxon_b, p{a} AS x, p{b} AS y, n FROM pats" for a in _T for b in _T if a < b)
_DIST = f"dist AS (SELECT taxon_a, taxon_b, sum(CASE WHEN bit_count(x) = 1 AND bit_count(y) = 1 THEN n ELSE 0 END)::BIGINT AS compared, sum(CASE WHEN bit_count(x) = 1 AND bit_count(y) = 1 AND x <> y THEN n ELSE 0 END)::BIGINT AS different FROM ({_PAIRS}) GROUP BY 1, 2)"
_USAGE = "usage AS (SELECT ((l_linenumber - 1) % 3)::INT AS pos, substr('ACGT', (l_partkey % 4 + 1)::INT, 1) AS base, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _code(name: str) -> str:
    letters = dict(zip(("".join(x) for x in product("TCAG", repeat=3)), GENETIC_CODES[name]))
    return "code(codon_index, codon, aa) AS (VALUES " + ", ".join(f"({i}, '{k}', '{letters[k]}')" for i, k in enumerate("".join(x) for x in product(BASES, repeat=3))) + ")"


_CODONS = "codons AS (SELECT c_custkey, ((c_custkey % 4) * 16 + (c_nationkey % 4) * 4 + floor(abs(c_acctbal))::BIGINT % 4)::INT AS codon_index FROM customer)"
_INTERVALS = "iv AS (SELECT event_type, ts::DATE AS day, count(*) AS attempts, sum(round(value * 100)::BIGINT)::BIGINT AS gain FROM events GROUP BY 1, 2)"
_LAST = "last AS (SELECT *, sum(attempts) OVER w AS attempts_last, sum(gain) OVER w AS gain_last FROM iv WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
_WEIGHTS = f"w AS (SELECT o_orderkey AS site, min(o_custkey) % 3 AS w FROM orders GROUP BY 1), ws AS (SELECT sites.*, coalesce(w.w, 1) AS w FROM sites LEFT JOIN w USING (site))"
_PRIO = ", ".join(f"coalesce(bit_or(CASE WHEN o_orderpriority = '{t}' THEN CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END END), 7) AS p{i}" for i, t in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
_TREE = "nodes(node, parent) AS (SELECT 'root', NULL UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
_STD25 = "CASE WHEN x & 1 = 0 THEN xor(x, 33554431::BIGINT) ELSE x END"
_AA_COUNTS = ", ".join(f"sum(length(t) - length(replace(replace(t, '{a}', ''), '{a.lower()}', ''))) AS {a}" for a in AMINO_ACIDS)
_AA_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS state, coalesce({a}, 0)::BIGINT AS n FROM wide" for a in AMINO_ACIDS)

SQL = {
    "q01_pattern_collapse": _BASE + f"SELECT {_TEXT} AS pattern, n AS count, first_site, bit_count({_OBS})::INT AS n_states, {_AND}::INT AS const_mask, {_TYPE} AS ptype FROM pats",
    "q02_pattern_types": _BASE + f"SELECT {_TYPE} AS ptype, sum(n)::BIGINT AS sites, count(*) AS patterns FROM pats GROUP BY 1",
    "q03_state_distribution": _BASE + f"SELECT bit_count({_OBS})::INT AS n_states, sum(n)::BIGINT AS sites, round(sum(n) / sum(sum(n)) OVER (), 6)::DOUBLE AS share FROM pats GROUP BY 1",
    "q04_constant_sites": _BASE + f"SELECT {_AND}::INT AS const_mask, sum(n)::BIGINT AS sites FROM pats WHERE {_AND} <> 0 GROUP BY 1",
    "q05_missing_by_site": f"WITH {_SITES} SELECT site, ({' + '.join(f'(CASE WHEN {p} = 7 THEN 1 ELSE 0 END)' for p in _P)})::INT AS n_missing FROM sites",
    "q06_base_freq_first_pass": _BASE + f", cells AS ({' UNION ALL '.join(f'SELECT {p} AS m, n FROM pats' for p in _P)}), st AS (SELECT s AS state, sum(n / bit_count(m)) AS share FROM cells, (VALUES (1), (2), (4)) v(s) WHERE m <> 7 AND m & s <> 0 GROUP BY 1) SELECT state::INT AS state, round(share / sum(share) OVER (), 6) AS freq FROM st",
    "q07_pseudocount_freq": f"WITH wide AS (SELECT {_AA_COUNTS} FROM (SELECT coalesce(text, '') AS t FROM documents)), raw AS ({_AA_ROWS}), k AS (SELECT state, n + CASE WHEN min(n) OVER () = 0 THEN 1 ELSE 0 END AS n FROM raw) SELECT state, n::BIGINT AS n, round(n / sum(n) OVER (), 6)::DOUBLE AS freq FROM k",
    "q08_f1x4": f"WITH {_USAGE}, {_code('standard')}, f AS (SELECT base, sum(n) / sum(sum(n)) OVER () AS f FROM usage GROUP BY base), p AS (SELECT codon, aa, a.f * b.f * d.f AS f FROM code JOIN f a ON a.base = substr(codon, 1, 1) JOIN f b ON b.base = substr(codon, 2, 1) JOIN f d ON d.base = substr(codon, 3, 1) WHERE aa <> '*') SELECT codon, aa, round(f / sum(f) OVER (), 8) AS freq FROM p",
    "q09_f3x4": f"WITH {_USAGE}, {_code('standard')}, f AS (SELECT pos, base, n / sum(n) OVER (PARTITION BY pos) AS f FROM usage), p AS (SELECT codon, aa, a.f * b.f * d.f AS f FROM code JOIN f a ON a.pos = 0 AND a.base = substr(codon, 1, 1) JOIN f b ON b.pos = 1 AND b.base = substr(codon, 2, 1) JOIN f d ON d.pos = 2 AND d.base = substr(codon, 3, 1) WHERE aa <> '*') SELECT codon, aa, round(f / sum(f) OVER (), 8) AS freq FROM p",
    "q10_position_usage_grouping_sets": f"WITH {_USAGE} SELECT pos, base, sum(n)::BIGINT AS n FROM usage GROUP BY GROUPING SETS ((pos, base), (pos), ())",
    "q11_translate": f"WITH {_CODONS}, {_code('vertmito')} SELECT codon, aa, count(*) AS n FROM codons JOIN code USING (codon_index) GROUP BY 1, 2",
    "q12_exclude_columns": f"WITH {_SITES} SELECT {_TEXT} AS pattern, count(*) AS count FROM sites WHERE site NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "q13_charset_stride": f"WITH {_SITES}, k AS (SELECT ((site - 1) % 3 + 1)::INT AS subset, {_TEXT} AS pattern, count(*) AS n FROM sites GROUP BY 1, 2) SELECT subset, sum(n)::BIGINT AS sites, count(*) AS patterns FROM k GROUP BY 1",
    "q14_split_by_nstates": _BASE + f"SELECT bit_count({_OBS})::INT AS n_states, sum(n)::BIGINT AS sites, count(*) AS patterns FROM pats WHERE {_OBS} <> 0 GROUP BY 1",
    "q15_weighted_collapse": f"WITH {_SITES}, {_WEIGHTS} SELECT {_TEXT} AS pattern, sum(w)::BIGINT AS count FROM ws GROUP BY 1 HAVING sum(w) > 0",
    "q16_uncollapse": f"WITH {_SITES} SELECT site, {_TEXT} AS pattern, count(*) OVER (PARTITION BY {_COLS}) AS count FROM sites",
    "q17_adjacent_dedup": f"WITH {_SITES}, k AS (SELECT site, {_TEXT} AS pattern FROM sites), g AS (SELECT *, lag(pattern) OVER (ORDER BY site) AS prev FROM k) SELECT site, pattern FROM g WHERE pattern IS DISTINCT FROM prev",
    "q18_hamming_pairs": _BASE + f", {_DIST} SELECT *, round(different / compared, 6) AS distance FROM dist",
    "q19_splits_from_sites": _BASE + f", {_SPLITS} SELECT split, n, {' || '.join(f'CASE WHEN split & {1 << i} <> 0 THEN chr(42) ELSE chr(45) END' for i in range(7))} AS picture, bit_count(split)::INT AS on_bits FROM splits",
    "q20_split_compat": _BASE + f", {_SPLITS} SELECT a.split, count(*) AS pairs, sum(CASE WHEN a.split & b.split = 0 OR a.split & xor(b.split, 127::BIGINT) = 0 OR xor(a.split, 127::BIGINT) & b.split = 0 OR xor(a.split, 127::BIGINT) & xor(b.split, 127::BIGINT) = 0 THEN 1 ELSE 0 END)::BIGINT AS compatible FROM splits a JOIN splits b ON a.split < b.split GROUP BY 1",
    "q21_constraint_semi": _BASE + f", {_SPLITS} SELECT * FROM splits WHERE split IN (3, 7, 15, 33)",
    "q22_constraint_anti": _BASE + f", {_SPLITS} SELECT * FROM splits WHERE split NOT IN (3, 7, 15, 33)",
    "q23_bit_algebra": _BASE + f", {_SPLITS} SELECT split, split | 85 AS union_, split & 85 AS inter, split & xor(85, 127)::BIGINT AS minus, xor(xor(split, 85::BIGINT), 127::BIGINT) AS xnor, bit_count(split)::INT AS on_bits, (split | 85) = 85 AS subset FROM splits",
    "q24_tree_closure": f"WITH RECURSIVE {_TREE}, up AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT up.node, nodes.parent, distance + 1 FROM up JOIN nodes ON up.ancestor = nodes.node WHERE nodes.parent IS NOT NULL) SELECT ancestor AS node, count(*) - 1 AS descendants, max(distance)::INT AS height FROM up GROUP BY 1",
    "q25_tree_splits": f"WITH s AS (SELECT 'r' || n_regionkey AS node, bit_or(1::BIGINT << n_nationkey) AS x FROM nation GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, 1::BIGINT << n_nationkey FROM nation) SELECT node, {_STD25} AS split, bit_count(x)::INT AS tips FROM s",
    "q26_tree_length": "SELECT n_regionkey AS tree_id, sum(round(abs(c_acctbal) * 100)::BIGINT)::BIGINT AS length_cents, count(*) AS branches FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "q27_topology_equal": f"WITH a AS (SELECT {_STD25} AS split FROM (SELECT bit_or(1::BIGINT << n_nationkey) AS x FROM nation GROUP BY n_regionkey)), b AS (SELECT {_STD25} AS split FROM (SELECT bit_or(1::BIGINT << n_nationkey) AS x FROM nation GROUP BY n_nationkey % 5)) SELECT count(*) FILTER (a.split = b.split) AS shared, count(*) FILTER (b.split IS NULL) AS only_a, count(*) FILTER (a.split IS NULL) AS only_b FROM a FULL JOIN b ON a.split = b.split",
    "q28_cumulative_selection": "SELECT user_id, event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / sum(abs(value)) OVER (PARTITION BY user_id), 6) AS cumulative FROM events",
    "q29_interval_window": f"WITH {_INTERVALS}, {_LAST} SELECT event_type, day, attempts, gain, attempts_last::BIGINT AS attempts_last, gain_last::BIGINT AS gain_last FROM last",
    "q30_adaptive_probs": f"WITH {_INTERVALS}, {_LAST}, r AS (SELECT event_type, day, CASE WHEN attempts_last > 0 THEN gain_last / attempts_last ELSE 0 END + 0.5::DOUBLE AS raw FROM last), p AS (SELECT event_type, day, greatest(raw / sum(raw) OVER (PARTITION BY day), 0.02::DOUBLE) AS p FROM r) SELECT event_type, day, round(p / sum(p) OVER (PARTITION BY day), 6) AS prob FROM p",
    "q31_site_windows": f"WITH {_SITES}, k AS (SELECT w.w AS window_id, {_TEXT} AS pattern, count(*) AS n FROM sites, LATERAL (SELECT unnest(generate_series(greatest(0, floor((site - 1000) / 500)::BIGINT + 1), site // 500)) AS w) w GROUP BY 1, 2) SELECT window_id, sum(n)::BIGINT AS sites, count(*) AS patterns FROM k GROUP BY 1",
    "q32_topk_suboptimal": "SELECT o_orderpriority, rank::INT AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10",
    "q33_best_of_replicates": "SELECT o_custkey, o_totalprice AS best, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "q34_best_so_far": "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events",
    "q35_rank_individuals": "SELECT c_custkey, c_nationkey, (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC))::INT AS rank FROM customer",
    "q37_swap_dedupe": "SELECT event_type, count(*) AS unique_swaps, sum(times)::BIGINT AS total_swaps, max(times) AS most FROM (SELECT user_id, event_type, count(*) AS times FROM events GROUP BY 1, 2) GROUP BY 1",
    "q38_cross_alignment_columns": f"WITH {_SITES}, k AS (SELECT {_TEXT} AS pattern, site % 2 AS side FROM sites) SELECT pattern, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM k GROUP BY 1 HAVING n_a > 0 AND n_b > 0",
    "q39_jc_likelihood_pair": _BASE + f", {_DIST} SELECT taxon_a, taxon_b, round(CASE WHEN different / compared < 0.75 THEN -0.75::DOUBLE * ln(1 - different / compared * 4 / 3) END, 6) AS jc_distance FROM dist",
    "q40_curve_grid": _BASE + f", {_DIST}, g AS (SELECT 0.01::DOUBLE * power(2, k) AS t FROM range(8) r(k)), v AS (SELECT *, 0.25::DOUBLE + 0.75::DOUBLE * exp(-4 * t / 3) AS same FROM dist, g) SELECT taxon_a, taxon_b, round(t, 4) AS t, round((compared - different) * ln(same / 4) + different * ln((1 - same) / 12), 4) AS lnl FROM v",
    "q41_codon_stop_anti": f"WITH {_CODONS}, {_code('standard')} SELECT codon_index, count(*) AS n FROM codons WHERE codon_index NOT IN (SELECT codon_index FROM code WHERE aa = '*') GROUP BY 1",
    "q42_event_day_windows": f"WITH {_INTERVALS} SELECT * FROM iv",
    "q43_charintwts_merge": f"WITH {_SITES}, {_WEIGHTS} SELECT {_TEXT} AS pattern, sum(w)::BIGINT AS count FROM ws GROUP BY 1 HAVING sum(w) > 0",
    "q44_polymorphic_cells": f"WITH cells AS (SELECT l_orderkey, l_linenumber AS taxon, bit_or({_MASK}) AS m FROM lineitem GROUP BY 1, 2) SELECT taxon, bit_count(m)::INT AS states, count(*) AS cells FROM cells GROUP BY 1, 2",
}
