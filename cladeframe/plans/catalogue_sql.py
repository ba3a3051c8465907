"""DuckDB SQL of the further queries."""

from __future__ import annotations

from math import exp

from ..functions.encode import AMINO_ACIDS, BASES, GENETIC_CODES, IUPAC
from ..operators.population import ANY_MODEL, ANY_TOPOLOGY, KINDS
from ..operators.resample import MODULUS, MULTIPLIER, powers_of_two
from .catalogue import MASKED, SUBSETS
from .oracles import _AND, _BASE, _COLS, _MASK, _P, _PATS, _PRIO, _SITES, _SPLITS, _TEXT, _TREE, _code

_KEEP = [p for i, p in enumerate(_P) if i + 1 not in (1, 2, 3)]
_SOME = [p for i, p in enumerate(_P) if i + 1 not in (2, 5)]
_CELLS = f"cells AS (SELECT l_orderkey AS site, l_linenumber AS taxon, bit_or({_MASK}) AS m FROM lineitem GROUP BY 1, 2)"
_CHAR = {k: v for k, v in IUPAC.items() if k != "U"}
_BACK = {v: k for k, v in IUPAC.items() if k not in "UN?-"} | {15: "-"}
_SUB = "sub(subset, first, last, step) AS (VALUES " + ", ".join(f"('{n}', {a}::BIGINT, {b}::BIGINT, {k}::BIGINT)" for n, a, b, k in SUBSETS) + ")"
_IN = f"part AS (SELECT sub.subset, sites.* FROM sites JOIN sub ON site BETWEEN first AND last AND (site - first) % step = 0)"
_UP = "up AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT up.node, nodes.parent, distance + 1 FROM up JOIN nodes ON up.ancestor = nodes.node WHERE nodes.parent IS NOT NULL)"
_UPPER = "nodes(node, parent) AS (SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
_UP_N = "up AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT up.node, nodes.parent, distance + 1 FROM up JOIN nodes ON up.ancestor = nodes.node WHERE nodes.parent <> 'root')"


def _case(values: dict, of: str) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {of} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + " END"


def _jumps(table: str, seed: str, steps: str, bits: int) -> str:
    """Common table expressions that carry x through the bits of ``steps``."""
    out = [f"j0 AS (SELECT *, ({seed})::BIGINT AS x FROM {table})"]
    for k, m in enumerate(powers_of_two(bits)):
        out.append(f"j{k + 1} AS (SELECT * REPLACE (CASE WHEN {steps} & {1 << k} <> 0 THEN x * {m} % {MODULUS} ELSE x END AS x) FROM j{k})")
    return ", ".join(out)


def _uniform(key: str, seed: int) -> str:
    m = MULTIPLIER**3 % MODULUS
    return f"((({key}) + {seed}) % {MODULUS - 1} + 1)::BIGINT * {m} % {MODULUS} / {MODULUS}::DOUBLE"


_PRIO_PATS = f"sites AS (SELECT o_custkey AS site, {_PRIO} FROM orders GROUP BY 1)"
_STD = lambda x, full: f"CASE WHEN {x} & 1 = 0 THEN xor({x}, {full}::BIGINT) ELSE {x} END"
_TAXA = lambda x, n: "concat_ws(',', " + ", ".join(f"CASE WHEN {x} & {1 << i} <> 0 THEN '{i + 1}' END" for i in range(n)) + ")"
_FIRST = lambda x, n: "CASE " + " ".join(f"WHEN {x} & {1 << i} <> 0 THEN {i + 1}" for i in range(n)) + " END"
_FULL500 = [(1 << 62) - 1] * 8 + [(1 << 4) - 1]
_W = range(9)
_SAME = "(1/3::DOUBLE + 2/3::DOUBLE * exp(-1.5::DOUBLE * 0.1::DOUBLE * rate))"

SQL = {
    "q45_pattern_order": _BASE + f"SELECT row_number() OVER (ORDER BY ({_AND} = 0)::INT, {_COLS}) AS position, {_TEXT} AS pattern, n AS count FROM pats",
    "q46_strip_missing": f"WITH {_SITES} SELECT count(*)::BIGINT AS sites, count(DISTINCT concat_ws(',', {', '.join(_KEEP)})) AS patterns FROM sites WHERE ({' & '.join(_KEEP)}) <> 7",
    "q47_drop_taxa": f"WITH {_SITES} SELECT concat_ws(',', {', '.join(_SOME)}) AS pattern, count(*) AS count FROM sites GROUP BY 1",
    "q48_partly_ambiguous": f"WITH {_CELLS} SELECT taxon, count(*) FILTER (bit_count(m) > 1 AND m <> 7) AS n_partial FROM cells GROUP BY 1",
    "q49_dummy_root": f"WITH {_SITES} SELECT {_TEXT} || ',7' AS pattern, count(*) AS count FROM sites GROUP BY 1",
    "q50_iupac_encode": f"WITH k AS (SELECT substr('ACGTMRWSYKVHDBN-?', (l_partkey % 17 + 1)::INT, 1) AS char FROM lineitem), e AS (SELECT char, {_case(_CHAR, 'char')} AS mask FROM k) SELECT char, mask, {_case(_BACK, 'mask')} AS back, count(*) AS n FROM e GROUP BY ALL",
    "q51_amino_encode": f"WITH k AS (SELECT substr('ACDEFGHIKLMNPQRSTVWYX*-', (p_partkey % 23 + 1)::INT, 1) AS letter FROM part) SELECT letter, {_case({a: i for i, a in enumerate(AMINO_ACIDS)}, 'letter')} AS state, count(*) AS n FROM k GROUP BY ALL",
    "q52_charpartition": f"WITH {_SITES}, {_SUB}, {_IN} SELECT subset, count(*)::BIGINT AS sites, count(DISTINCT {_TEXT}) AS patterns FROM part GROUP BY 1",
    "q53_codons_of_sites": f"WITH {_CELLS}, {_code('standard')}, k AS (SELECT taxon, floor((site - 1) / 3) AS codon, " + ", ".join(f"max(CASE WHEN (site - 1) % 3 = {j} AND bit_count(m) = 1 THEN CASE m WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END END) AS b{j}" for j in range(3)) + " FROM cells WHERE m <> 7 GROUP BY 1, 2) SELECT taxon, CASE WHEN aa IS NULL OR aa = '*' THEN '?' ELSE aa END AS aa, count(*) AS n FROM k LEFT JOIN code ON codon_index = b0 * 16 + b1 * 4 + b2 GROUP BY 1, 2",
    "q54_genetic_codes": "WITH c(code, letters) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GENETIC_CODES.items()) + "), l AS (SELECT code, two_serines, i, substr(letters, i, 1) AS a FROM c, (VALUES (false), (true)) t(two_serines), range(1, 65) r(i)) SELECT code, two_serines, CASE WHEN two_serines AND a = 'S' AND i > 32 THEN 'Z' ELSE a END AS aa, count(*) AS codons FROM l GROUP BY 1, 2, 3",
    "q55_base_freq_em": "WITH RECURSIVE " + _SITES + ", " + _PATS + f", cells AS ({' UNION ALL '.join(f'SELECT {p} AS m, n FROM pats' for p in _P)}), m AS (SELECT " + ", ".join(f"coalesce(sum(n) FILTER (m = {k}), 0)::DOUBLE AS m{k}" for k in range(1, 7)) + " FROM cells), r(i, a, b, d) AS (SELECT 0, 1/3::DOUBLE, 1/3::DOUBLE, 1/3::DOUBLE UNION ALL SELECT i + 1, x / (x + y + z), y / (x + y + z), z / (x + y + z) FROM (SELECT i, m1 + m3 * a / (a + b) + m5 * a / (a + d) AS x, m2 + m3 * b / (a + b) + m6 * b / (b + d) AS y, m4 + m5 * d / (a + d) + m6 * d / (b + d) AS z FROM r, m WHERE i < 200)), f AS (SELECT * FROM r WHERE i = 200) SELECT 1 AS state, round(a, 5) AS freq FROM f UNION ALL SELECT 2, round(b, 5) FROM f UNION ALL SELECT 4, round(d, 5) FROM f",
    "q56_subset_models": f"WITH {_SITES}, {_SUB}, {_IN}, mo(subset, model_id, rate) AS (VALUES ('first', 1, 0.5::DOUBLE), ('second', 1, 1.0::DOUBLE), ('rest', 2, 2.0::DOUBLE)), k AS (SELECT model_id, CASE WHEN p1 = p2 THEN ln({_SAME} / 3) ELSE ln((1 - {_SAME}) / 6) END AS l FROM part JOIN mo USING (subset) WHERE bit_count(p1) = 1 AND bit_count(p2) = 1) SELECT model_id, round(sum(l), 4) AS lnl, count(*)::BIGINT AS sites FROM k GROUP BY 1",
    "q57_masked_splits": _BASE + f", {_SPLITS}, k(other, mask) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in MASKED) + "), x AS (SELECT split, other, mask, mask & 119 AS j FROM splits, k) SELECT split, other, (split & mask) = (other & mask) OR (split & mask) = xor(mask, other & mask) AS same, ((split & mask) | (other & mask)) = (other & mask) AS subset, j AS joint, bit_count(split & j) >= 2 AND bit_count(j & xor(split, 127::BIGINT)) >= 2 AS meaningful FROM x",
    "q58_split_taxa": _BASE + f", {_SPLITS} SELECT split, {_TAXA('split', 7)} AS taxa, {_FIRST('split', 7)} AS first_present, {_FIRST('xor(split, 127::BIGINT)', 7)} AS first_absent, split AS back, '(' || {_TAXA('split', 7)} || ') | (' || {_TAXA('xor(split, 127::BIGINT)', 7)} || ')' AS picture, (row_number() OVER (ORDER BY split))::INT AS position FROM splits",
    "q59_constraint_pairs": "WITH k(s) AS (VALUES " + ", ".join(f"({x}::BIGINT)" for x in (3, 5, 7, 15, 33, 97)) + ") SELECT a.s AS split, b.s AS other, a.s & b.s = 0 OR a.s & xor(b.s, 127::BIGINT) = 0 OR xor(a.s, 127::BIGINT) & b.s = 0 OR xor(a.s, 127::BIGINT) & xor(b.s, 127::BIGINT) = 0 AS compatible FROM k a, k b WHERE a.s < b.s",
    "q60_splits_after_move": f"WITH b AS (SELECT 'r' || n_regionkey AS node, bit_or(1::BIGINT << n_nationkey) AS x FROM nation GROUP BY 1), a AS (SELECT 'r' || CASE WHEN n_nationkey = 6 THEN 0 ELSE n_regionkey END AS node, bit_or(1::BIGINT << n_nationkey) AS x FROM nation GROUP BY 1), j AS (SELECT node, {_STD('b.x', 33554431)} AS before, {_STD('a.x', 33554431)} AS after FROM b FULL JOIN a USING (node)) SELECT * FROM j WHERE before IS DISTINCT FROM after",
    "q61_tip_distances": "SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END AS distance FROM nation a, nation b WHERE 'n' || a.n_nationkey < 'n' || b.n_nationkey",
    "q62_collapse_short": f"WITH {_TREE}, t AS (SELECT node, parent, CASE WHEN starts_with(parent, 'n') AND substr(parent, 2)::INT % 3 = 0 THEN (SELECT p.parent FROM nodes p WHERE p.node = nodes.parent) ELSE parent END AS up FROM nodes WHERE parent IS NOT NULL) SELECT up AS parent, count(*) AS children FROM t WHERE NOT (starts_with(node, 'n') AND substr(node, 2)::INT % 3 = 0 AND node IN (SELECT parent FROM nodes)) GROUP BY 1",
    "q63_reroot": "WITH h AS (SELECT 'r' || n_regionkey AS r FROM nation WHERE n_nationkey = 7) SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey = 7 THEN NULL ELSE 'r' || n_regionkey END AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN 'r' || r_regionkey = h.r THEN 'n7' ELSE 'root' END FROM region, h UNION ALL SELECT 'root', h.r FROM h",
    "q64_nearest_tips": f"WITH RECURSIVE {_TREE}, {_UP}, tips AS (SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)) SELECT ancestor AS node, distance::INT AS distance, node AS tip FROM (SELECT up.*, row_number() OVER (PARTITION BY ancestor ORDER BY distance, node) AS r FROM up JOIN tips USING (node) WHERE distance > 0) WHERE r = 1",
    "q65_reconnections": "WITH n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS r FROM nation), k AS (SELECT c.node AS cut, t.node, CASE WHEN c.r = t.r THEN 2 ELSE 4 END - 2 AS distance FROM n c, n t WHERE c.node <> t.node AND c.node IN ('n1', 'n2', 'n3') UNION ALL SELECT c.node, 'r' || r_regionkey, CASE WHEN c.r = 'r' || r_regionkey THEN 0 ELSE 1 END FROM n c, region WHERE c.node IN ('n1', 'n2', 'n3')) SELECT cut, node, distance::INT AS distance, (row_number() OVER (PARTITION BY cut ORDER BY distance, node))::INT AS nth FROM k WHERE distance BETWEEN 1 AND 2",
    "q66_window_frequencies": f"WITH {_SITES}, k AS ({' UNION ALL '.join(f'SELECT site // 2000 AS window_id, {p} AS state FROM sites' for p in _P)}), n AS (SELECT window_id, state, count(*)::BIGINT AS n FROM k WHERE bit_count(state) = 1 GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY window_id), 6) AS freq FROM n",
    "q67_random_individuals": "SELECT c_custkey, md5('42:' || c_custkey) AS h FROM customer ORDER BY h, c_custkey LIMIT 50",
    "q68_subset_union": _BASE + f"SELECT {_TEXT} AS pattern, n::BIGINT AS count, first_site FROM pats",
    "q69_distinct_topologies": f"WITH s AS (SELECT o_custkey, o_orderstatus, bit_or(1::BIGINT << (substr(o_orderpriority, 1, 1)::INT - 1)) AS x FROM orders GROUP BY 1, 2), t AS (SELECT DISTINCT o_custkey, {_STD('x', 31)} AS split FROM s), u AS (SELECT o_custkey, string_agg(split::VARCHAR, ',' ORDER BY split) AS splits FROM t GROUP BY 1) SELECT splits, count(*) AS n_trees, min(o_custkey) AS first_tree FROM u GROUP BY 1",
    "q70_ratchet": _BASE + f", u AS (SELECT first_site, n, {_uniform('first_site', 42)} AS u FROM pats) SELECT first_site, n AS orig_count, greatest(0, n + CASE WHEN u < 0.25 THEN 1 WHEN u >= 0.75 THEN -1 ELSE 0 END)::BIGINT AS count FROM u",
    "q71_reset_counts": _BASE + "SELECT first_site, n AS count FROM pats",
    "q72_proportional_resample": f"WITH {_PRIO_PATS}, pats AS (SELECT (site % 2)::INT AS subset, min(site) AS first_site, count(*) AS n FROM sites GROUP BY site % 2, p0, p1, p2, p3, p4), cum AS (SELECT subset, first_site, sum(n) OVER (PARTITION BY subset ORDER BY first_site) AS hi, n FROM pats), t AS (SELECT subset, sum(n) AS total, round(sum(n) * 0.5)::BIGINT AS draws FROM pats GROUP BY 1), o AS (SELECT *, coalesce(sum(draws) OVER (ORDER BY subset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip, (sum(draws) OVER ())::BIGINT AS each_ FROM t), d AS (SELECT subset, total, rep::INT AS rep, (rep - 1) * each_ + skip + i AS step FROM o, range(1, 5) r(rep), LATERAL (SELECT unnest(generate_series(1, draws)) AS i)), {_jumps('d', '7', 'step', 31)} SELECT j31.subset, rep, first_site, count(*) AS n FROM j31 JOIN cum ON cum.subset = j31.subset AND x % total >= hi - n AND x % total < hi GROUP BY 1, 2, 3",
    "q73_unconditioned": _BASE + f"SELECT sum(n)::BIGINT AS sites, count(*) AS patterns FROM pats WHERE NOT (bit_count(p1) = 1 AND {' AND '.join(f'{p} = p1' for p in _P[1:])})",
    "q74_exponential": f"SELECT event_id, round({_uniform('event_id', 11)}, 9) AS u, round(-ln({_uniform('event_id', 11)}) / 10.0::DOUBLE, 6) AS x FROM events",
    "q75_shuffle": "SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey)))::INT AS place FROM customer",
    "q76_selection": "WITH l AS (SELECT c_nationkey, c_custkey, c_acctbal / 1000 AS lnl FROM customer), w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY lnl DESC, c_custkey) AS rank, exp(-0.5::DOUBLE * (max(lnl) OVER (PARTITION BY c_nationkey) - lnl)) AS w FROM l), p AS (SELECT *, w / sum(w) OVER (PARTITION BY c_nationkey) AS prob FROM w) SELECT c_nationkey, c_custkey, rank::INT AS rank, round(prob, 6) AS prob, round(sum(prob) OVER (PARTITION BY c_nationkey ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS cumulative, rank <= 1 AS kept FROM p",
    "q77_mutation_kinds": "WITH k AS (SELECT event_id % 256 AS k FROM events) " + " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) FILTER (k & {b} <> 0) AS n FROM k" for n, b in (KINDS | {"any_topology": ANY_TOPOLOGY, "any_model": ANY_MODEL}).items()),
    "q78_population_edits": "WITH f AS (SELECT c_mktsegment AS seg, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey))::INT AS rank, c_custkey FROM customer QUALIFY rank <= 4), a AS (SELECT * FROM f UNION ALL SELECT f.seg, r.r::INT, f.c_custkey FROM f JOIN (SELECT seg, count(*) AS n FROM f GROUP BY 1) USING (seg), range(1, 7) r(r) WHERE f.rank = 1 AND r.r > n) SELECT CASE WHEN rank = 2 AND seg = 'BUILDING' THEN 'MACHINERY' WHEN rank = 2 AND seg = 'MACHINERY' THEN 'BUILDING' ELSE seg END AS c_mktsegment, rank, c_custkey FROM a",
    "q79_progress": "WITH n AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS total, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, max(CASE WHEN before IS NULL OR value > before + 0.01::DOUBLE THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS improved FROM n) SELECT user_id, event_id, round(i / total, 6) AS fraction, best, improved, i - improved >= 5 AS done FROM b",
    "q80_column_ranges": f"WITH {_SITES}, k AS (SELECT site, site // 4096 AS b FROM sites WHERE {_AND} <> 0), r AS (SELECT site, b, site - row_number() OVER (PARTITION BY b ORDER BY site) AS run FROM k) SELECT min(site) AS first, max(site) AS last FROM r GROUP BY b, run",
    "q81_taxon_numbers": "SELECT n_regionkey, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::INT AS number, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)) AS names_twice FROM nation",
    "q82_parents": "WITH l AS (SELECT c_nationkey, c_custkey, c_acctbal / 1000 AS lnl FROM customer), w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY lnl DESC, c_custkey) AS rank, exp(-0.5::DOUBLE * (max(lnl) OVER (PARTITION BY c_nationkey) - lnl)) AS w FROM l), p AS (SELECT *, w / sum(w) OVER (PARTITION BY c_nationkey) AS prob FROM w), q AS (SELECT *, sum(prob) OVER (PARTITION BY c_nationkey ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative FROM p), d AS (SELECT n_nationkey AS c_nationkey, k::INT AS child, " + _uniform("n_nationkey * 4 + k", 5) + " AS u FROM nation, range(1, 5) r(k)) SELECT c_nationkey, child, min(rank)::INT AS rank FROM d JOIN q USING (c_nationkey) WHERE cumulative >= u GROUP BY 1, 2",
    "q83_wide_splits": "WITH e AS (SELECT vec_id % 500 AS t, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), w AS (SELECT dim, " + ", ".join(f"coalesce(bit_or(1::BIGINT << (t % 62)::INT) FILTER (t // 62 = {k}), 0) AS w{k}" for k in _W) + " FROM e WHERE x > 0 GROUP BY 1), s AS (SELECT dim, " + ", ".join(f"CASE WHEN w0 & 1 = 0 THEN xor(w{k}, {_FULL500[k]}::BIGINT) ELSE w{k} END AS s{k}" for k in _W) + " FROM w) SELECT dim::INT AS dim, concat_ws(',', " + ", ".join(f"s{k}" for k in _W) + ") AS words, (" + " + ".join(f"bit_count(s{k})::INT" for k in _W) + ")::INT AS on_bits FROM s",
    "q84_tree_lengths_scaled": f"SELECT c_nationkey, round(sum(abs(c_acctbal)), 4) AS before, round(sum(greatest(1e-8::DOUBLE, abs(c_acctbal) * exp(0.5::DOUBLE * ({_uniform('c_custkey', 3)} - 0.5::DOUBLE)))), 4) AS after FROM customer GROUP BY 1",
}

# A bootstrap replicate has as many draws as the matrix has columns, all of one stream.
SQL["q36_lcg_bootstrap"] = f"WITH {_PRIO_PATS}, pats AS (SELECT min(site) AS first_site, count(*) AS n FROM sites GROUP BY p0, p1, p2, p3, p4), cum AS (SELECT first_site, sum(n) OVER (ORDER BY first_site) AS hi, n FROM pats), t AS (SELECT sum(n)::BIGINT AS total FROM pats), d AS (SELECT total, rep::INT AS rep, (rep - 1) * total + i AS step FROM t, range(1, 11) r(rep), LATERAL (SELECT unnest(generate_series(1, total)) AS i)), {_jumps('d', '42', 'step', 31)} SELECT rep, first_site, count(*) AS n FROM j31 JOIN cum ON x % total >= hi - n AND x % total < hi GROUP BY 1, 2"


def _leaf(p: str) -> list[str]:
    return [f"(CASE WHEN {p} & {1 << s} <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for s in range(3)]


def _three_states(newick: str) -> tuple[str, list[int], dict[int, str]]:
    """SQL steps that carry the likelihoods of three states of equal frequencies up a tree; the inner nodes in the
    order in which the steps make them; and each step's columns."""
    from ..sources.newick import parse_newick

    tree = parse_newick(newick)
    kids, steps, inner, last = tree.children(), [], [], "pats"
    for v in reversed(range(len(tree.parent))):
        if not kids[v]:
            continue
        terms = []
        for s in range(3):
            factors = []
            for k in kids[v]:
                e = exp(-1.5 * tree.length[k])
                below = [f"n{k}_{j}" for j in range(3)] if kids[k] else _leaf(f"p{tree.label[k]}")
                factors.append("(" + " + ".join(f"{(1 / 3 + 2 / 3 * e if j == s else 1 / 3 - 1 / 3 * e)!r}::DOUBLE * {below[j]}" for j in range(3)) + ")")
            terms.append(" * ".join(factors) + f" AS n{v}_{s}")
        steps.append(f"t{v} AS (SELECT *, {', '.join(terms)} FROM {last})")
        last = f"t{v}"
        inner.append(v)
    return ", ".join(steps), inner, {v: f"t{v}" for v in inner}


def _score(newick: str) -> str:
    steps, _, _ = _three_states(newick)
    return f"WITH {_SITES}, {_PATS}, {steps} SELECT n, {_COLS}, ln((n0_0 + n0_1 + n0_2) / 3) AS lnl FROM t0"


def _kernel_sql() -> dict[str, str]:
    from .queries import TREES7

    one = " UNION ALL ".join(f"SELECT {i} AS tree_id, round(sum(n * lnl), 4) AS lnl FROM ({_score(t)})" for i, t in TREES7)
    sites = f"SELECT site, round(lnl, 6) AS lnl FROM (WITH {_SITES} SELECT * FROM sites) JOIN ({_score(TREES7[0][1])}) USING ({_COLS})"
    return {"k01_score_tree": one, "k05_site_likelihoods": sites}


SQL |= _kernel_sql()
