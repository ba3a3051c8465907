"""Newick trees as node tables, and back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s(),:;\[\]']+)")


@dataclass
class Tree:
    """Nodes 0..n-1, the root being 0: parent (-1 for the root), label or None, branch length or None."""

    parent: list[int] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    length: list[float | None] = field(default_factory=list)

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.label.append(None)
        self.length.append(None)
        return len(self.parent) - 1

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(i)
        return out

    def tips(self) -> list[int]:
        return [i for i, k in enumerate(self.children()) if not k]


def parse_newick(text: str, translate: dict[str, str] | None = None) -> Tree:
    """Polytomies, quoted names, comments and lengths are understood; a malformed tree raises ValueError."""
    translate = translate or {}
    tokens = [m.group(1) for m in _TOKEN.finditer(text) if not m.group(1).startswith("[")]
    tree, i = Tree(), 0

    def name(t: str) -> str:
        t = t[1:-1].replace("''", "'") if t.startswith("'") else t
        return translate.get(t, t)

    stack: list[int] = []
    node = tree.add(-1)
    while i < len(tokens):
        t = tokens[i]
        if t == "(":
            stack.append(node)
            node = tree.add(node)
        elif t == ",":
            if not stack:
                raise ValueError("a comma outside of parentheses")
            node = tree.add(stack[-1])
        elif t == ")":
            if not stack:
                raise ValueError("a parenthesis too many")
            node = stack.pop()
        elif t == ":":
            i += 1
            tree.length[node] = float(tokens[i])
        elif t == ";":
            break
        else:
            tree.label[node] = name(t)
        i += 1
    if stack:
        raise ValueError("a parenthesis is not closed")
    return tree


def write_newick(tree: Tree, digits: int = 8) -> str:
    kids = tree.children()

    def quoted(s: str | None) -> str:
        return "" if s is None else s if re.fullmatch(r"[^\s(),:;\[\]']+", s) else "'" + s.replace("'", "''") + "'"

    # Children first, without recursion: a ladder may have any depth.
    order, todo = [], [0]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += kids[n]
    out: dict[int, str] = {}
    for n in reversed(order):
        inner = "(" + ",".join(out.pop(k) for k in kids[n]) + ")" if kids[n] else ""
        out[n] = inner + quoted(tree.label[n]) + (f":{tree.length[n]:.{digits}f}" if tree.length[n] is not None else "")
    return out[0] + ";"


def nodes_of(trees: DataFrame) -> DataFrame:
    """Rows (tree_id, newick) to rows (tree_id, node, parent, label, blen), in Arrow batches."""
    import pandas as pd

    kind = trees.schema["tree_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, n, t.parent[n] if t.parent[n] >= 0 else None, t.label[n], t.length[n]) for i, s in zip(b["tree_id"], b["newick"]) for t in [parse_newick(s)] for n in range(len(t.parent))]
            yield pd.DataFrame(rows, columns=["tree_id", "node", "parent", "label", "blen"])

    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, node int, parent int, label string, blen double").withColumn("parent", F.col("parent").cast("int"))
