"""Text operators against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeframe.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, passage_dedup, piece_codec, quality_rules, sharding, token_count
from cladeframe.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, template int, at int, n int, w string, h string, part int"
WORDS = [f"w{i:03d}" for i in range(400)]


def words_of(text, pattern):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(pattern, low)


ALNUM, BLANK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    base, shared = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (9, "One  TWO"),
        (10, prose(3, 40) + " " + shared + " " + prose(4, 50)), (11, shared + "\n" + prose(5, 80)), (12, prose(6, 20000)), (12, prose(7, 30)), (12, prose(7, 30)), (None, base), (None, "Released under the MIT License."),
        (13, "mit license MIT-License\nthe General Public license, apache\tlicense all rights reserved É"), (14, "same line\nother line\n" * 30), (15, "ÀÉÎ ñandú ß K İ 日本語 😀 don't  stop <|endoftext|> x ▁ y"), (16, "###*** $$$ &&&"), (17, "x" * 5000),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # The further columns have names that the operators use themselves.
    return spark.createDataFrame([(i, t, "xx", "s", None, "l", 1, 2, 3, "w", "h", 4) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return Counter(map(repr, rows))


def test_license_scan(docs, texts, nothing):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for i, t in texts:
        w = words_of(t, ALNUM)
        at = [(p, k) for k in phrases for p in range(len(w)) if tuple(w[p : p + len(k)]) == k]
        starts = [p for p, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({phrases[k] for _, k in at}))))
    got = license_scan.scan_licenses(docs).collect()
    assert multiset((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == multiset(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 13).labels == "apache,gpl,mit,proprietary"
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_notice_with_edits(spark):
    notice = license_scan.NOTICES[0].text.split()
    notice[5:7] = ["for", "no", "fee"]
    d = spark.createDataFrame([(1, prose(1, 50) + " " + " ".join(notice) + " " + prose(2, 50)), (2, prose(3, 100))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(d).collect()}
    assert got[1].labels == "mit" and 0.6 <= got[1].score < 1 and got[2].labels == ""


def contaminated(texts, items):
    out = []
    for i, t in texts:
        w, hit, found = words_of(t, ALNUM), set(), set()
        for k, s in items:
            v = words_of(s, ALNUM)
            n = min(10, len(v))
            windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    if k is not None:
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_decontamination(spark, docs, texts, nothing, block_rows):
    base = prose(1, 120).split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[20:30])), (20, "one two"), (3, None), (4, ""), (5, prose(8, 30)), (6, prose(6, 20000)[500:900]), (7, " ".join(base[10:40])), (8, "same line other line same line other line same line other"), (None, " ".join(base[100:115]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_overlaps(docs, b, block_rows=block_rows).collect()
    assert multiset(tuple(r) for r in got) == multiset(contaminated(texts, items))
    assert decontaminate.find_overlaps(nothing, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_overlaps(docs, b.limit(0)).collect())


def test_quality_statistics(docs, texts, nothing):
    want = []
    for i, t in texts:
        t = t or ""
        w = re.findall(BLANK, t)
        seen, rep = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)), set()
        for a in range(len(w) - 4):
            if seen[tuple(w[a : a + 5])] > 1:
                rep |= set(range(a, a + 5))
        lines = [x for x in t.split("\n") if re.search(BLANK, x)]
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep), failed))
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_filter(docs, labels).collect()
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == multiset(want)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.quality_filter(nothing, labels).count() == 0


def test_rules_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.6) & (x[:, 4] < 0.3))
    rules = quality_rules.learn_rules(x, bad, np.arange(600) % 3 == 0)
    covered = np.any([quality_rules._covers(r, x) for r in rules], axis=0)
    assert (covered == bad).mean() > 0.95 and not (covered & ~bad).mean() > 0.02


def test_sharding(docs, texts, nothing):
    got = sharding.shard_documents(docs, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert multiset((r.doc_id, r.size, r.text_crc32) for r in got) == multiset((i, size(t), None if t is None else zlib.crc32(t.encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    totals = Counter()
    for t in {t for _, t in texts}:
        totals[(hashlib.md5(t.encode()).hexdigest() + f"{size(t):016X}") if t is not None else ""] += sum(size(u) for _, u in texts if u == t)
    groups = [totals[k] for k in sorted(totals)]

    def feasible(cap):
        shards, at = 1, 0
        for g in groups:
            if g > cap:
                return False
            shards, at = (shards, at + g) if at + g <= cap else (shards + 1, g)
        return shards <= 8

    best = next(c for c in range(max(groups), sum(groups) + 1) if feasible(c))
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) == best
    assert sharding.shard_documents(nothing).count() == 0


def test_language_id(spark, docs, nothing):
    make = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list(make[k]), 5)) for _ in range(30)), k) for i, k in enumerate(list(make) * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(d).collect()
    truth = {i: k for i, _, k in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and any(r.held_out for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95
    got = language_id.identify_languages(docs).collect()
    assert all((r.lang_pred == "und") == (not language_id.LETTER.search(t or "")) for r, (_, t) in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(docs.select("doc_id", "text").collect(), key=lambda r: repr(r[0]))) if r.doc_id not in (None, 12))
    assert language_id.identify_languages(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", docs.lang.substr(9, 0)).where("false").unionByName(docs)).collect()} == {"und", "xx"}


def components(sets, ids, num, den):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [ids[i] if not sets[i] else least.get(find(i)) for i in range(len(sets))]


def shingles(t, k):
    w = words_of(t, BLANK)
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(spark, docs, texts, nothing, k, num, den):
    more, rng = list(texts), np.random.default_rng(5)
    chain = prose(9, 100).split()
    for i in range(40):
        chain[int(rng.integers(100))] = f"new{i}"
        more.append((100 + i, " ".join(chain)))
    for i in range(40):
        w = prose(10, 60).split()
        for at in rng.integers(0, 60, int(rng.integers(0, 3))):
            w[at] = f"x{i}"
        more.append((200 + i, " ".join(w)))
    got = jaccard_join.link_sets(spark.createDataFrame(more, "doc_id long, text string"), k=k, num=num, den=den).collect()
    sets = [shingles(t, k) for _, t in more]
    want = components(sets, [i for i, _ in more], num, den)
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == multiset((i, len(s), c) for (i, _), s, c in zip(more, sets, want))
    assert jaccard_join.link_sets(nothing).count() == 0


def test_signatures_share_a_part():
    rng, classes = np.random.default_rng(3), jaccard_join.Classes(9, 10)
    for n in (1, 5, 9, 10, 11, 19, 27, 28, 60, 199, 300):
        for _ in range(20):
            a = set(rng.integers(0, 1 << 62, n).tolist())
            b, m = set(a), n
            while True:
                b2 = set(list(b)[1:]) | ({int(rng.integers(0, 1 << 62))} if rng.random() < 0.5 else set())
                if 10 * len(a & b2) < 9 * len(a | b2):
                    break
                b = b2
            s = [set(jaccard_join.signatures(np.array([len(x)]), np.array(sorted(x), np.uint64), classes)[1].tolist()) for x in (a, b)]
            assert s[0] & s[1], (n, m)


def test_codec(docs, texts, nothing):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    encoded = piece_codec.encode_pieces(docs, model)
    got = encoded.collect()
    assert multiset((r.doc_id, tuple(r.ids), r.n_tokens) for r in got) == multiset((i, tuple(sp.encode(t or "")), len(sp.encode(t or ""))) for i, t in texts)
    assert all(r.round_trip for r in got if r.doc_id != 15)
    back = multiset((r.doc_id, r.text) for r in piece_codec.decode_pieces(encoded, model).collect())
    assert back == multiset((i, (t or "").replace("▁", " ")) for i, t in texts)
    assert piece_codec.encode_pieces(nothing, model).count() == 0


def test_token_counts(docs, texts, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in texts]
    assert multiset(tuple(r) for r in token_count.count_tokens(docs, path).collect()) == multiset(want)
    assert token_count.count_tokens(nothing, path).count() == 0


def test_line_dedup(spark, nothing):
    passage = "\n".join(f"line {i} of a passage" for i in range(12))
    rows = [(1, "a\nb\n" + passage + "\nend"), (2, "other start\n" + passage + "\nz"), (3, None), (4, ""), (5, "\n\n\n"), (6, "one line"), (7, "one line"), (2, "other start\n" + passage + "\nz"), (None, passage), (8, passage), (9, passage)]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, chunk string, place int")
    got = line_dedup.dedup_lines(d).collect()
    assert len(got) == len(rows) and all(len(r.text or "") <= len(t or "") for r, (_, t) in zip(sorted(got, key=lambda r: (repr(r.doc_id), -len(r.text or ""))), sorted(rows, key=lambda r: (repr(r[0]), -len(r[1] or "")))))
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.text)
    assert by[None] == {passage} and by[3] == {None} and by[4] == {""} and by[5] == {"\n\n\n"} and by[6] == by[7] == {"one line"} and len(by[2]) == 1
    assert by[8] == by[9] and all(r.n_removed >= 4 for r in got if r.doc_id in (1, 2, 8, 9)), got
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_passages(spark, nothing):
    shared = prose(21, 55)
    near = shared.split() + prose(29, 15).split()
    near2 = list(near)
    near2[30] = "other"
    rows = [(1, prose(22, 90) + " " + shared + " " + prose(23, 70)), (2, shared + " " + prose(24, 200)), (3, prose(25, 300)), (4, None), (5, ""), (6, prose(26, 30)), (7, prose(26, 30)), (8, prose(27, 80)), (9, prose(27, 80)), (8, prose(27, 80)), (10, " ".join(near)), (11, prose(28, 60) + " " + " ".join(near2)), (None, prose(30, 60))]
    got = passage_dedup.find_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == classes[2] == classes[10] == classes[11] == 1 and classes[8] == classes[9] == 8 and set(classes) == {1, 2, 8, 9, 10, 11}
    assert next(r for r in got if r.doc_id == 2).passage_start == 0
    assert passage_dedup.find_repeated_passages(nothing).count() == 0


def test_compact_windows_cover_all_minima():
    h = np.random.default_rng(2).permutation(80)
    windows = passage_dedup.compact_windows(h, 10)
    for i in range(80):
        for j in range(i + 9, 80):
            c = i + int(h[i : j + 1].argmin())
            assert sum(a <= i <= m <= j <= b and m == c for a, m, b in windows) == 1


def test_chunks_are_compared_without_their_text(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(d)._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" in plan and "min(chunk" not in plan and "max(chunk" not in plan


def test_whole_runs_go(spark, nothing):
    rng = np.random.default_rng(31)
    passages = ["\n".join(prose(int(rng.integers(1 << 30)), 8) for _ in range(n)) for n in (2, 3, 4, 7, 12, 30)]
    passages.append("first line\n\n\n\nsecond line\n \nthird line")
    rows = [(100 * i + j, f"own {i} {j}\nline {i} {j}\n{p}\nend {i} {j}") for i, p in enumerate(passages) for j in range(5)]
    rows += [(1000 + i, p) for i, p in enumerate(passages)] + [(2000 + i, p + "\n\n") for i, p in enumerate(passages)]
    rows += [(3000, "same\n" * 9), (3001, "lone line"), (3002, "lone line"), (3003, None), (3004, "\n\n"), (3005, "\n\n"), (None, passages[0])]
    got = {r.doc_id: r for r in line_dedup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(r.n_lines == len(t.split("\n")) for i, t in rows if t is not None for r in [got[i]])
    for i, p in enumerate(passages):
        for j in range(5):
            kept = i > 0 and j == 0
            assert got[100 * i + j].text == f"own {i} {j}\nline {i} {j}\n{p if kept else ''}{chr(10) if kept else ''}end {i} {j}"
            assert got[100 * i + j].n_removed == (0 if kept else len(p.split("\n")))
        assert got[1000 + i].text == got[2000 + i].text == ""
    assert got[None].text == passages[0] and got[3000].text == "same" and got[3003].text is None
    assert got[3001].text == got[3002].text == "lone line" and got[3004].text == got[3005].text == "\n\n"
    left = {x for r in got.values() for x in (r.text or "").split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n") if x.strip()} <= left
    assert line_dedup.dedup_runs(nothing).count() == 0


def test_similar_passages_are_recalled(spark):
    rows = []
    for i in range(300):
        w = [f"p{i}x{j}" for j in range(50)]
        near = list(w)
        near[10 + i % 30] = "changed"
        rows += [(2 * i, f"{prose(500 + i, 30)} " + " ".join(w)), (2 * i + 1, " ".join(near) + f" {prose(900 + i, 30)}")]
    got = {r.doc_id: r.class_id for r in passage_dedup.find_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(2 * i) == got.get(2 * i + 1) == 2 * i for i in range(300)), len(got)


def test_all_places_of_a_minimum_are_tried(spark):
    rows = []
    for i in range(60):
        w = [f"p{i}x{j}" for j in range(60)]
        rows += [(2 * i, " ".join(w[12:47] + [f"a{i}x{j}" for j in range(20)] + w)), (2 * i + 1, " ".join([f"b{i}x{j}" for j in range(20)] + w))]
    got = {r.doc_id: r for r in passage_dedup.find_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 120 and all(got[2 * i].passage_start == 55 and got[2 * i + 1].passage_start == 20 and got[2 * i].passage_words == 60 for i in range(60))


def test_links_and_passages_are_whole(spark):
    a, b = prose(41, 70), prose(42, 90)
    near = [f"n{j}" for j in range(80)]
    near2 = list(near)
    near2[40] = "changed"
    rows = [(i, f"{prose(600 + i, 20)} {a} {prose(700 + i, 20)}") for i in range(6)] + [(i, f"{prose(600 + i, 20)} {b} {prose(700 + i, 30)}") for i in range(6, 9)]
    rows += [(9, f"{prose(609, 10)} {a} {prose(709, 25)} {b}"), (10, " ".join(near)), (11, " ".join(near2))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passage_dedup.find_repeated_passages(d).collect()}
    assert [(got[i].class_id, got[i].n_docs, got[i].n_passages) for i in range(12)] == [(0, 10, 1)] * 9 + [(0, 10, 2)] + [(10, 2, 1)] * 2
    assert got[9].passage_words == 90 and got[9].passage_start == 105 and got[10].passage_words == got[11].passage_words == 80
    rest = passage_dedup.find_all_passages(d).collect()
    mine = defaultdict(set)
    for r in rest:
        mine[r.doc_id].add((r.passage_start, r.passage_words, r.passage_class))
    assert {x[:2] for x in mine[9]} == {(10, 70), (105, 90)} and len({x[2] for i in range(6) for x in mine[i]} | {x[2] for x in mine[9]}) == 2
    assert all({x[:2] for x in mine[i]} == {(20, 70)} for i in range(6))
    assert {r.n_docs for r in rest if r.doc_id < 6} == {7} and {r.n_docs for r in rest if 6 <= r.doc_id < 9} == {4}


def linked_by_windows(texts):
    """Brute force: pairs of different texts with windows of 46 shingles of a similarity of 0.8, and the words of exact ones."""
    gs = {i: [tuple(w[a : a + 5]) for a in range(len(w) - 4)] for i, w in texts.items() if len(w) >= 50}
    places, pairs, exact = defaultdict(list), set(), defaultdict(set)
    for i, g in gs.items():
        for a, x in enumerate(g):
            places[x].append((i, a))
    diagonals = defaultdict(set)
    for x in places.values():
        for i, a in x:
            for j, b in x:
                if i < j and texts[i] != texts[j]:
                    diagonals[i, j].add(a - b)
    for (i, j), offs in diagonals.items():
        u, v = gs[i], gs[j]
        for off in offs:
            for s in range(max(0, off), min(len(u), len(v) + off) - 45):
                x, y = u[s : s + 46], v[s - off : s - off + 46]
                if x == y:
                    exact[i] |= set(range(s, s + 50))
                    exact[j] |= set(range(s - off, s - off + 50))
                if (i, j) not in pairs and len(both := set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
                    pairs.add((i, j))
    return pairs, exact


@pytest.mark.parametrize("small", [128, 4])
def test_passages_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(passage_dedup, "SMALL", small)
    monkeypatch.setattr(passage_dedup, "LATER", small)
    rng, rows = np.random.default_rng(5), []
    line = prose(77, 12)
    for f in range(8):
        base = [f"f{f}x{k}" for k in range(130)]
        for j in range(12):
            w = list(base)
            for k in rng.choice(130, int(rng.integers(1, 7)), replace=False):
                w[k] = f"e{f}x{j}x{k}"
            cut = int(rng.integers(0, 60))
            rows.append((f"{f}-{j}", f"{prose(3000 + 20 * f + j, 30)} {line} {' '.join(w[cut:])}"))
    texts = {i: words_of(t, ALNUM) for i, t in rows}
    pairs, exact = linked_by_windows(texts)
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in passage_dedup.find_repeated_passages(d).collect()}
    both = sum(i in got and j in got and got[i].class_id == got[j].class_id for i, j in pairs)
    assert len(pairs) > 100 and both >= 0.9 * len(pairs), (both, len(pairs))
    assert {x for p in pairs for x in p} >= set(got)
    held = defaultdict(set)
    for r in passage_dedup.find_all_passages(d).collect():
        held[r.doc_id] |= set(range(r.passage_start, r.passage_start + r.passage_words))
    assert all(exact[i] <= held[i] for i in exact)


def test_frequent_pre_tokens_are_of_all_partitions(spark):
    from tokenizers import Tokenizer

    rows = [(i, " alpha beta") for i in range(900)] + [(1000 + i, " gamma delta") for i in range(900)] + [(5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    table = token_count._frequent(d, "doc_id", "text", t, [], 100, 200)
    assert {" alpha", " beta", " gamma", " delta"} <= set(table)
    long = spark.createDataFrame([(1, " epsilon" * 20000)], "doc_id long, text string")
    assert " epsilon" in token_count._frequent(long, "doc_id", "text", t, [], 100, 200)


def test_least_elements_are_shared_and_few():
    rng, classes = np.random.default_rng(4), jaccard_join.Classes(4, 5)
    sigs = lambda x: set(jaccard_join.signatures(np.array([len(x)]), np.array(sorted(x), np.uint64), classes)[1].tolist())
    for n in (1, 4, 5, 6, 18, 19, 60, 199, 460):
        for _ in range(10):
            a = set(rng.integers(0, 1 << 62, n).tolist())
            b = set(a)
            while True:
                b2 = set(list(b)[1:]) | ({int(rng.integers(0, 1 << 62))} if rng.random() < 0.5 else set())
                if 5 * len(a & b2) < 4 * len(a | b2):
                    break
                b = b2
            assert sigs(a) & sigs(b) and len(sigs(a)) <= 0.45 * n + 2
            # Parities never put sets farther apart than they are, and put others far apart.
            other = set(rng.integers(0, 1 << 62, n).tolist())
            held = [jaccard_join.parities(np.array(sorted(x), np.uint64)) for x in (a, b, other)]
            apart = jaccard_join.least_apart(held, np.array([0, 0]), np.array([1, 2]))
            assert apart[0] <= len(a ^ b) and (n < 60 or apart[1] > 2 * n / 9)


def test_sets_with_elements_in_common_only_are_not_moved(spark, monkeypatch):
    common, asked = prose(21, 60), []
    rows = [(i, f"{common} {prose(100 + i, 240)}") for i in range(40)] + [(100 + i, f"{prose(300, 200)} z{i}") for i in range(5)]
    made = jaccard_join.wanted
    monkeypatch.setattr(jaccard_join, "wanted", lambda nodes, *a, **b: (asked.append(nodes.count()), made(nodes, *a, **b))[1])
    got = {r.doc_id: r.component_id for r in jaccard_join.link_sets(spark.createDataFrame(rows, "doc_id long, text string"), k=5, num=4, den=5).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows} and asked == [5]


def test_repeated_chunks_go_before_runs(spark, monkeypatch):
    seen, write = {}, line_dedup.Scratch.write
    monkeypatch.setattr(line_dedup.Scratch, "write", lambda self, df, name: seen.setdefault(name, write(self, df, name)))
    text = "\n".join(f"line {i} of it" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"other\n{text}\n\nlast"), (None, "line 3 of it\nline 4 of it"), (4, "alone")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_runs(docs).collect()}
    assert got == {1: ("\n".join(f"line {i} of it" for i in range(60) if i not in (3, 4)), 2), 2: ("other\nlast", 61), None: ("line 3 of it\nline 4 of it", 0), 4: ("alone", 0)}
    gone = [(r._i, r.n) for r in seen["chunks"].collect()]
    assert {i for i, _ in gone} == {2} and sum(n for _, n in gone) > 30


def test_groups_of_few_bytes_are_compared_in_several_tasks(spark):
    from pyspark.sql import functions as F

    s = list(range(2 * passage_dedup.SIDE + 1))
    members = spark.createDataFrame([(part, node, 50, node, s) for part in range(30) for node in (1, 2)], "part long, node long, at int, component long, s array<int>")
    got = passage_dedup._compared(members).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 30 and len({r.task for r in got}) > 3
