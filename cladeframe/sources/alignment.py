"""Readers of aligned matrices: NEXUS, PHYLIP and FASTA."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Alignment:
    """Rows of equal length, and what a file says about its columns (numbered from 1). A cell is a character; where a
    matrix has cells of several states, rows are lists, and such a cell is its states in parentheses."""

    rows: dict[str, str | list[str]]
    datatype: str = "dna"
    missing: str = "?"
    gap: str = "-"
    charsets: dict[str, list[int]] = field(default_factory=dict)
    excluded: set[int] = field(default_factory=set)
    weights: dict[int, int] = field(default_factory=dict)
    trees: dict[str, str] = field(default_factory=dict)
    symbols: str = "01"
    equate: dict[str, str] = field(default_factory=dict)
    partitions: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    title: str = ""
    model: str = ""

    def __post_init__(self) -> None:
        if len({len(r) for r in self.rows.values()}) > 1:
            raise ValueError("rows of unequal length")

    @property
    def n_columns(self) -> int:
        return len(next(iter(self.rows.values()), ""))

    def columns(self, charset: str | None = None) -> list[int]:
        """Columns of a charset (or all) that are not excluded; it is an error if none is left."""
        chosen = [x for x in (self.charsets[charset] if charset else range(1, self.n_columns + 1)) if x not in self.excluded]
        if not chosen:
            raise ValueError("every column is excluded")
        return chosen

    def subsets(self, partition: str | None = None) -> dict[str, list[int]]:
        """The columns of each subset of a partition, without excluded ones; a subset of which none is left raises. Without
        a partition all columns are one subset."""
        if not self.partitions:
            return {"all": self.columns()}
        name = partition or next(iter(self.partitions))
        out = {k: [x for x in cols if x not in self.excluded] for k, cols in self.partitions[name].items()}
        empty = [k for k, cols in out.items() if not cols]
        if empty:
            raise ValueError(f"every column of {', '.join(empty)} is excluded")
        return out

    @property
    def full(self) -> int:
        """The mask of a cell that may be any state."""
        n = 4 if self.datatype in ("dna", "rna", "nucleotide") else 20 if self.datatype in ("protein", "aminoacid") else len(self.symbols)
        return (1 << n) - 1

    def masks(self, columns: list[int] | None = None) -> list[list[int]]:
        """State masks, one row for each taxon: a bit for each state; a gap or missing cell may be any state."""
        from ..functions.encode import AMINO_ACIDS, IUPAC

        if self.datatype in ("dna", "rna", "nucleotide"):
            table, full = IUPAC, 15
        else:
            states = AMINO_ACIDS if self.datatype in ("protein", "aminoacid") else self.symbols
            table, full = {x: 1 << i for i, x in enumerate(states)}, (1 << len(states)) - 1
            if states is AMINO_ACIDS:
                table = table | {"X": full, "*": full, "B": table["D"] | table["N"], "Z": table["E"] | table["Q"]}
        columns = columns or list(range(1, self.n_columns + 1))

        def mask(cell: str) -> int:
            cell = "".join(self.equate.get(x, x) for x in cell)
            if cell in (self.missing, self.gap):
                return full
            out = 0
            for x in cell.strip("(){}"):
                found = table.get(x, table.get(x.upper()))
                if found is None:
                    raise ValueError(f"unknown state {x}")
                out |= found
            return out

        return [[mask(row[i - 1]) for i in columns] for row in self.rows.values()]


def sniff(text: str) -> str:
    """nexus, fasta or phylip, by the first characters."""
    start = text.lstrip()
    return "nexus" if start[:6].upper() == "#NEXUS" else "fasta" if start.startswith(">") else "phylip"


def read_alignment(text: str) -> Alignment:
    """The only matrix of a text; a text of several has to be read by ``read_blocks``."""
    if sniff(text) == "nexus":
        blocks = _nexus(text)
        if len(blocks) > 1:
            raise ValueError(f"{len(blocks)} matrices; read them as blocks")
        return blocks[0]
    return {"fasta": _fasta, "phylip": _phylip}[sniff(text)](text)


def column_ranges(spec: str, last: int, charsets: dict[str, str] | None = None) -> list[int]:
    r"""Columns of a list such as ``1-9\3 12 20-.``; a point is the last column, and a name another set's columns."""
    out: list[int] = []
    for m in re.finditer(r"(?P<a>\d*[A-Za-z_][\w.]*|\d+|\.)(?:\s*-\s*(?P<b>\d+|\.)(?:\s*\\\s*(?P<k>\d+))?)?", spec):
        if not m["a"].isdigit() and m["a"] != ".":
            if m["a"].lower() == "all":
                out += range(1, last + 1)
            elif charsets and m["a"].lower() in charsets:
                out += column_ranges(charsets[m["a"].lower()], last, charsets)
            else:
                raise ValueError(f"no set of columns {m['a']}")
            continue
        a, b = (last if x == "." else int(x) if x else None for x in (m["a"], m["b"]))
        out += [a] if b is None else list(range(a, b + 1, int(m["k"] or 1)))
    return out


def _fasta(text: str) -> Alignment:
    rows: dict[str, str] = {}
    for part in text.split(">")[1:]:
        head, _, body = part.partition("\n")
        name = head.split()[0]
        if name in rows:
            raise ValueError(f"taxon {name} twice")
        rows[name] = "".join(body.split())
    return Alignment(rows)


def _phylip(text: str) -> Alignment:
    lines = [x for x in text.splitlines() if x.strip()]
    n_taxa, n_columns = map(int, lines[0].split()[:2])
    rows: dict[str, str] = {}
    rest = iter(lines[1:])
    for line in rest:
        name, _, body = line.strip().partition(" ")
        seq = "".join(body.split())
        while len(seq) < n_columns:
            seq += "".join(next(rest).split())
        if name in rows:
            raise ValueError(f"taxon {name} twice")
        rows[name] = seq
    if len(rows) != n_taxa:
        raise ValueError(f"{len(rows)} taxa, not {n_taxa}")
    return Alignment(rows)


def _commands(text: str):
    """(block, command word, rest) of a NEXUS text without comments; a block begins with the word begin."""
    block = ""
    for raw in re.sub(r"\[[^\]]*\]", " ", text).split(";"):
        command = raw.strip()
        if command[:6].upper() == "#NEXUS":
            command = command[6:].strip()
        word, _, rest = command.replace("\t", " ").partition(" ") if "\n" not in command.split(" ")[0] else command.partition("\n")
        if word.lower() == "begin":
            block = rest.strip().lower()
            yield block, "begin", ""
        elif word.lower() in ("end", "endblock"):
            block = ""
        elif word:
            yield block, word.lower(), rest


def _cells(text: str) -> list[str]:
    """Characters of a row; states in parentheses or braces are one cell."""
    return re.findall(r"\([^)]*\)|\{[^}]*\}|\S", re.sub(r"(?<=[({])([^)}]*)(?=[)}])", lambda m: re.sub(r"[\s,]", "", m[1]), text))


def read_blocks(text: str) -> list[Alignment]:
    """All matrices of a NEXUS text, each with the sets that stand after it and before the next one; other formats have one."""
    return _nexus(text) if sniff(text) == "nexus" else [read_alignment(text)]


def _nexus(text: str) -> list[Alignment]:
    """A data or characters block begins a matrix; trees and model lines belong to all of them."""
    found: list[dict] = []
    taxa: list[str] = []
    trees, translate, model = {}, {}, []
    new = lambda: {"rows": {}, "kind": "dna", "missing": "?", "gap": "-", "n": 0, "interleave": False, "charsets": {}, "partitions": {}, "excluded": "", "weights": "", "symbols": "01", "equate": {}, "match": None, "title": "", "labels": True}
    for block, word, rest in _commands(text):
        if block in ("data", "characters") and word == "begin":
            found.append(new())
        now = found[-1] if found else new()
        if block == "taxa" and word.startswith("taxlabels"):
            taxa = [x[1:-1] if x.startswith("'") else x for x in re.findall(r"'[^']*'|\S+", rest)]
        elif block in ("data", "characters"):
            if word == "dimensions":
                now["n"] = int(re.search(r"nchar\s*=\s*(\d+)", rest, re.I)[1])
            elif word == "title":
                now["title"] = rest.strip()
            elif word == "format":
                get = lambda k, d: (m[1].strip('"') if (m := re.search(rf"\b{k}\s*=\s*(\"[^\"]*\"|\S+)", rest, re.I)) else d)
                now |= {"kind": get("datatype", now["kind"]).lower(), "missing": get("missing", now["missing"]), "gap": get("gap", now["gap"]), "match": get("matchchar", None)}
                symbols = get("symbols", "01").replace(" ", "")
                if "~" in symbols:
                    symbols = "".join(chr(x) for x in range(ord(symbols[0]), ord(symbols[-1]) + 1))
                now["symbols"] = symbols
                now["equate"] = dict(re.findall(r"(\S)\s*=\s*(\([^)]*\)|\{[^}]*\}|\S)", get("equate", "")))
                now["interleave"] = bool(re.search(r"\binterleave\b(?!\s*=\s*no)", rest, re.I))
            elif word.startswith("matrix"):
                name, rows = None, now["rows"]
                for line in rest.splitlines():
                    m = re.match(r"\s*('(?:[^']|'')*'|\S+)\s*(.*)", line)
                    if not m:
                        continue
                    if name is None or now["interleave"] or len(rows[name]) >= now["n"]:
                        name = m[1][1:-1].replace("''", "'") if m[1].startswith("'") else m[1]
                        if name in rows and not now["interleave"]:
                            raise ValueError(f"taxon {name} twice")
                        rows.setdefault(name, [])
                        rows[name] += _cells(m[2])
                    else:
                        rows[name] += _cells(line)
        elif word in ("charset", "exset", "wtset", "charpartition"):
            m = re.match(r"\s*(\*?)\s*(\S+?)\s*(?:\([^)]*\))?\s*=\s*(.*)", rest, re.S)
            if word == "charset":
                now["charsets"][m[2].lower()] = m[3]
            elif word == "charpartition":
                now["partitions"][m[2]] = m[3]
            elif word == "exset" and m[1]:
                now["excluded"] = m[3]
            elif word == "wtset" and m[1]:
                now["weights"] = m[3]
        elif block == "trees" and word == "translate":
            translate = dict(x.split(None, 1) for x in rest.split(",") if x.strip())
        elif block == "trees" and word in ("tree", "utree"):
            name, _, newick = rest.partition("=")
            trees[name.strip(" *\n")] = newick.strip() + ";"
        elif len(block.split()) == 1 and block not in ("paup", "taxa", "trees", "sets", "assumptions", "notes") and word != "begin" and re.fullmatch(r"[A-Za-z]\d*", word):
            model.append(f"{word} {rest}")
    if translate:
        trees = {k: re.sub(r"(?<=[(,])\s*([^(),:;\s]+)", lambda m: translate.get(m[1], m[1]).strip(), v) for k, v in trees.items()}
    out = []
    for x in found or [new()]:
        rows, last = x["rows"], x["n"] or len(next(iter(x["rows"].values()), ""))
        if x["match"] and rows:  # the first row says what the sign stands for
            first = next(iter(rows.values()))
            rows = {k: [first[i] if v == x["match"] else v for i, v in enumerate(r)] for k, r in rows.items()}
        plain = {k: "".join(r) if all(len(v) == 1 for v in r) else r for k, r in rows.items()}
        sets = {k: column_ranges(v, last, x["charsets"]) for k, v in x["charsets"].items()}
        parts = {k: {n.strip().lower(): column_ranges(cols, last, x["charsets"]) for n, cols in re.findall(r"([^:,]+):\s*([^,]*)", v)} for k, v in x["partitions"].items()}
        by_weight = {c: int(w) for w, cols in re.findall(r"(\d+)\s*:\s*([^,]*)", x["weights"]) for c in column_ranges(cols, last, x["charsets"])}
        out.append(Alignment(plain, x["kind"], x["missing"], x["gap"], sets, set(column_ranges(x["excluded"], last, x["charsets"])), by_weight, trees, x["symbols"], x["equate"], parts, x["title"], "\n".join(model)))
    return out


def read_matrices(spark: SparkSession, paths: str) -> DataFrame:
    """Cells (matrix_id, taxon, taxon_idx, site, char, mask) of all matrices of all files under a path, in Arrow batches of a
    row of a matrix each. A file is parsed by one task, as its format asks for; a file of several matrices gives each
    its number after a #."""
    import pyarrow as pa

    names = ["matrix_id", "taxon", "taxon_idx", "site", "char", "mask"]

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = read_blocks(text)
                for k, block in enumerate(blocks):
                    for i, ((name, row), masks) in enumerate(zip(block.rows.items(), block.masks())):
                        n = len(row)
                        yield pa.RecordBatch.from_arrays([pa.array([path if len(blocks) == 1 else f"{path}#{k + 1}"] * n), pa.array([name] * n), pa.array([i] * n, pa.int32()), pa.array(range(1, n + 1), pa.int32()), pa.array(list(row)), pa.array(masks, pa.int64())], names)

    files = spark.read.text(paths, wholetext=True).selectExpr("_metadata.file_path AS path", "value AS text")
    return files.mapInArrow(run, "matrix_id string, taxon string, taxon_idx int, site int, char string, mask long")
