"""Text forms of matrices, trees and models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_.]+", name) else "'" + name.replace("'", "''") + "'"


def nexus_matrix(rows: dict[str, str], datatype: str = "dna") -> str:
    n = len(next(iter(rows.values()), ""))
    body = "\n".join(f"{_quoted(k)} {v}" for k, v in rows.items())
    return f"#NEXUS\nbegin data;\ndimensions ntax={len(rows)} nchar={n};\nformat datatype={datatype} missing=? gap=-;\nmatrix\n{body}\n;\nend;\n"


def phylip_matrix(rows: dict[str, str]) -> str:
    n = len(next(iter(rows.values()), ""))
    return f"{len(rows)} {n}\n" + "".join(f"{k} {v}\n" for k, v in rows.items())


def fasta_matrix(rows: dict[str, str]) -> str:
    return "".join(f">{k}\n{v}\n" for k, v in rows.items())


def nexus_trees(trees: dict[str, str], taxa: list[str]) -> str:
    """A trees block with a translate table; taxon names in the trees become numbers."""
    table = ",\n".join(f"{i + 1} {_quoted(t)}" for i, t in enumerate(taxa))
    number = {t: str(i + 1) for i, t in enumerate(taxa)}
    body = "\n".join(f"tree {k} = [&U] " + re.sub(r"(?<=[(,])([^(),:;]+)", lambda m: number.get(m[1], m[1]), v) for k, v in trees.items())
    return f"#NEXUS\nbegin trees;\ntranslate\n{table};\n{body}\nend;\n"


def sequences(cells: DataFrame) -> DataFrame:
    """Cells (matrix_id, taxon, site, char) to rows (matrix_id, taxon, sequence) in order of the sites."""
    packed = F.sort_array(F.collect_list(F.struct("site", "char")))
    return cells.groupBy("matrix_id", "taxon").agg(F.array_join(F.transform(packed, lambda x: x["char"]), "").alias("sequence"))


def write_trees(trees: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Rows (tree_id, newick, lnl) as text lines, and as parquet beside them."""
    trees.write.mode(mode).parquet(f"{path}/table")
    trees.select(F.concat(F.lit("[&U][lnL "), F.format_number("lnl", 6), F.lit("] "), "newick").alias("value")).write.mode(mode).text(f"{path}/text")
