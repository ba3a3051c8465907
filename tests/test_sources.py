import pytest

from cladeframe.sources.alignment import column_ranges, read_alignment, read_blocks, read_matrices, sniff
from cladeframe.sources.config import Constraint, RunConfig, model_parameters, parse_constraints, rate_classes, recorded, satisfies
from cladeframe.sources.newick import Tree, parse_newick, write_newick
from cladeframe.sources.writers import fasta_matrix, nexus_matrix, nexus_trees, phylip_matrix, sequences

ROWS = {"taxon A": "ACGT-N", "b_2": "ACGTRN", "c": "AC--NN"}


def test_round_trips():
    for text in (nexus_matrix(ROWS), phylip_matrix({k.replace(" ", "_"): v for k, v in ROWS.items()}), fasta_matrix({k.replace(" ", "_"): v for k, v in ROWS.items()})):
        assert list(read_alignment(text).rows.values()) == list(ROWS.values())
    assert list(read_alignment(nexus_matrix(ROWS)).rows) == list(ROWS)
    assert [sniff(x) for x in ("#nexus\n", ">a\nAC", "2 3\na ACG")] == ["nexus", "fasta", "phylip"]


def test_nexus_sets_and_trees():
    text = nexus_matrix(ROWS) + "begin sets;\ncharset third = 3-.\\3;\nexset * out = 2 5-6;\nend;\nbegin assumptions;\nwtset * w = 2: 1 3, 0: 4;\nend;\n" + nexus_trees({"t": "(a:1,b:2,(c:1,d:1):.5);"}, list("abcd")).removeprefix("#NEXUS\n")
    a = read_alignment(text)
    assert a.charsets == {"third": [3, 6]} and a.excluded == {2, 5, 6} and a.weights == {1: 2, 3: 2, 4: 0} and a.columns("third") == [3]
    assert sorted(x for x in parse_newick(a.trees["t"]).label if x) == list("abcd")
    a.excluded |= {3}
    with pytest.raises(ValueError):
        a.columns("third")
    assert column_ranges("1-7\\3 9 8 - .", 10) == [1, 4, 7, 9, 8, 9, 10]


@pytest.mark.parametrize("bad", ["((a,b);", "(a,b));", "a,b;"])
def test_bad_newick(bad):
    with pytest.raises(ValueError):
        parse_newick(bad)


def test_newick():
    text = "('it''s':0.10000000,(b:0.20000000,c:0.30000000)x:0.05000000,d:1.00000000);"
    assert write_newick(parse_newick(text)) == text


def test_read_files(spark, tmp_path):
    (tmp_path / "m.nex").write_text(nexus_matrix(ROWS))
    cells = read_matrices(spark, str(tmp_path / "m.nex"))
    assert {r["taxon"]: r["sequence"] for r in sequences(cells).collect()} == ROWS


def test_config():
    conf = RunConfig.parse("# run\n[general]\nDatafname = x.nex\nnumratecats = 3\nrefinestart = 0\n[master]\nnindivs= 6\n")
    assert conf.get("general", "numratecats") == 3 and conf.get("general", "refinestart") is False and conf.get("master", "holdover") == 1 and conf.validate() == []
    assert RunConfig.parse("[general]\ndatatype = what\n").validate()
    with pytest.raises(ValueError):
        RunConfig.parse("[general]\nnumratecats = many\n").get("general", "numratecats")
    with pytest.raises(ValueError):
        RunConfig.parse("[a]\nx = 1\nx = 2\n")
    assert model_parameters("r 1 2 1 1 2 1 e .25 .25 .25 .25 a 0.5;")["M1"]["a"] == [0.5] and rate_classes("(0 1 2 2 3 4)") == [0, 1, 2, 2, 3, 4]


def test_constraints():
    taxa = list("abcdef")
    (one,) = parse_constraints("+ ((a,b),c,d,e,f);", taxa)
    assert one == Constraint(3, True, 63) == parse_constraints("+**....", taxa)[0]
    (back,) = parse_constraints("-((a,b),c,d);", taxa)
    assert back.mask == 15 and not back.positive
    splits = frozenset([0b000011, 0b001111])
    assert satisfies(splits, one) and not satisfies(splits, back) and satisfies(frozenset([0b000101]), back)


BLOCKS = """#NEXUS
begin taxa; dimensions ntax=3; taxlabels a b 'c d'; end;
begin characters; title first; dimensions nchar=6; format datatype=dna gap=- matchchar=.;
matrix a ACGT-N
b ..G..A
'c d' .C.{AG}?A ;
end;
begin characters; dimensions nchar=4; format datatype=standard symbols="0~3" equate="x=(01)" missing=?;
matrix a 01(1 2)3
b 0x2?
'c d' 3210;
end;
begin sets; charset one = 1-2; charset two = 3-.; charpartition halves = p1:one, p2:two; end;
begin assumptions; exset * gone = 2; end;
begin model; M1 r 1 2 3 1 2 1 e .1 .2 .3 .4; M2 a 0.5 p 0.1; S 0.5 1.5; end;
"""


def test_blocks_symbols_and_partitions():
    dna, standard = read_blocks(BLOCKS)
    assert dna.rows["b"] == "ACGT-A" and dna.rows["c d"] == ["A", "C", "G", "{AG}", "?", "A"] and dna.title == "first"
    assert dna.masks()[2] == [1, 2, 4, 5, 15, 1] and dna.masks([4])[1] == [8]
    assert standard.symbols == "0123" and standard.masks() == [[1, 2, 6, 8], [1, 3, 4, 15], [8, 4, 2, 1]]
    assert standard.subsets() == {"p1": [1], "p2": [3, 4]} and standard.charsets["two"] == [3, 4]
    standard.excluded = {1, 2}
    with pytest.raises(ValueError):
        standard.subsets()
    with pytest.raises(ValueError):
        read_alignment(BLOCKS)
    with pytest.raises(ValueError):
        read_blocks("#NEXUS\nbegin data; dimensions nchar=2; format datatype=dna; matrix a AC\na GT; end;")
    assert model_parameters(dna.model) == {"M1": {"r": [1, 2, 3, 1, 2, 1], "e": [0.1, 0.2, 0.3, 0.4]}, "M2": {"a": [0.5], "p": [0.1]}, "S": {"": [0.5, 1.5]}}


def test_recorded_trees():
    (one,) = recorded("tree best = [&U][!XScore -12.5][!XModel r 1 1 1 1 1 1 e .25 .25 .25 .25 ](a:1,b:2,c:.5);")
    assert one["score"] == -12.5 and one["parameters"]["M1"]["e"] == [0.25] * 4 and one["newick"] == "(a:1,b:2,c:.5);"


def test_deep_ladder():
    tree = Tree()
    at = tree.add(-1)
    for i in range(5000):
        tip = tree.add(at)
        tree.label[tip] = f"t{i}"
        at = tree.add(at)
    tree.label[at] = "last"
    assert parse_newick(write_newick(tree)).parent == tree.parent


def test_getters():
    conf = RunConfig.parse("[general]\nscorethreshforterm = 0.05\noutgroup = 1-3 7\n[master]\nnindivs = 0\n")
    assert conf.number("general", "scorethreshforterm", positive=True) == 0.05 and conf.ranges("general", "outgroup") == [1, 2, 3, 7]
    assert conf.number("general", "nosuch", optional=True) is None and conf.ranges("general", "nosuch") == []
    for call in (lambda: conf.number("master", "nindivs", positive=True), lambda: conf.number("general", "nosuch"), lambda: conf.number("general", "scorethreshforterm", low=1)):
        with pytest.raises(ValueError):
            call()
