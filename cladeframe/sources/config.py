"""Run configuration: sections of ``name = value`` lines with typed getters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Option names and the defaults that the file format gives them.
DEFAULTS = {
    "general": {"datafname": None, "constraintfile": "none", "streefname": "stepwise", "attachmentspertaxon": 50, "ofprefix": "run", "randseed": -1, "logevery": 10, "saveevery": 100, "refinestart": True, "genthreshfortopoterm": 10000, "scorethreshforterm": 0.05, "significanttopochange": 0.01, "writecheckpoints": False, "restart": False, "outputsitelikelihoods": 0, "collapsebranches": True, "optimizeinputonly": False, "searchreps": 1, "datatype": "nucleotide", "ratematrix": "6rate", "statefrequencies": "estimate", "ratehetmodel": "gamma", "numratecats": 4, "invariantsites": "estimate"},
    "master": {"nindivs": 4, "holdover": 1, "selectionintensity": 0.5, "holdoverpenalty": 0.0, "bootstrapreps": 0, "resampleproportion": 1.0, "intervallength": 100, "intervalstostore": 5, "inferinternalstateprobs": False, "limsprrange": 6},
}
DATATYPES = {"nucleotide", "dna", "rna", "aminoacid", "protein", "codon", "codon-aminoacid", "standard", "standardvariable", "standardordered", "standardorderedvariable", "binary", "binarynotallzeros"}
RATE_MATRICES = {"1rate", "2rate", "6rate", "fixed", "estimate", "poisson", "dayhoff", "jones", "wag", "mtmam", "mtrev"}


@dataclass
class RunConfig:
    sections: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        """Names are case-insensitive; lines that start with # are comments; a name given twice raises."""
        out: dict[str, dict[str, str]] = {}
        section = None
        for n, raw in enumerate(text.splitlines(), 1):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            if line.startswith("[") and line.endswith("]"):
                section = out.setdefault(line[1:-1].strip().lower(), {})
                continue
            name, eq, value = line.partition("=")
            if section is None or not eq:
                raise ValueError(f"line {n} is neither a section nor a setting: {line}")
            if name.strip().lower() in section:
                raise ValueError(f"line {n} sets {name.strip()} again")
            section[name.strip().lower()] = " ".join(value.split())
        return cls(out)

    def get(self, section: str, name: str, default=None):
        """The value in the type of its default; a value of another type raises."""
        default = DEFAULTS.get(section, {}).get(name) if default is None else default
        raw = self.sections.get(section, {}).get(name)
        if raw is None:
            return default
        try:
            if isinstance(default, bool):
                return {"0": False, "false": False, "no": False, "1": True, "true": True, "yes": True}[raw.lower()]
            return type(default)(raw) if isinstance(default, (int, float)) else raw
        except (KeyError, ValueError):
            raise ValueError(f"[{section}] {name} = {raw} is no {type(default).__name__}") from None

    def number(self, section: str, name: str, *, positive: bool = False, low: float | None = None, high: float | None = None, optional: bool = False):
        """A number within bounds; an absent one raises, or with ``optional`` is None."""
        value = self.get(section, name)
        if value is None:
            if optional:
                return None
            raise ValueError(f"[{section}] {name} is missing")
        value = float(value) if isinstance(value, str) else value
        if positive and value <= 0 or low is not None and value < low or high is not None and value > high:
            raise ValueError(f"[{section}] {name} = {value} is out of range")
        return value

    def ranges(self, section: str, name: str, last: int = 0) -> list[int]:
        """A list of numbers and ranges such as ``1-3 7``; empty if it is absent or none."""
        from .alignment import column_ranges

        raw = self.sections.get(section, {}).get(name, "none")
        return [] if raw.lower() == "none" else column_ranges(raw, last)

    def validate(self) -> list[str]:
        """What does not go together; empty if the run can start."""
        wrong = []
        models = [k for k in self.sections if k.startswith("model")] or ["general"]
        for m in models:
            kind, rates = self.get(m, "datatype", "nucleotide").lower(), self.get(m, "ratematrix", "6rate").lower()
            classes, het = self.get(m, "numratecats", 4 if self.get(m, "ratehetmodel", "gamma") != "none" else 1), self.get(m, "ratehetmodel", "gamma")
            if kind not in DATATYPES:
                wrong.append(f"[{m}] unknown datatype {kind}")
            if rates not in RATE_MATRICES and not rates.startswith("("):
                wrong.append(f"[{m}] unknown rate matrix {rates}")
            if not 1 <= classes <= 20:
                wrong.append(f"[{m}] rate classes must be 1 to 20")
            if kind.startswith(("standard", "binary")) and het not in ("none",) and "ratehetmodel" in self.sections.get(m, {}):
                wrong.append(f"[{m}] {kind} data allow no rate heterogeneity")
        if not 0 < self.get("master", "resampleproportion"):
            wrong.append("[master] resampleproportion must be positive")
        if self.get("master", "holdover") > self.get("master", "nindivs"):
            wrong.append("[master] holdover is above nindivs")
        return wrong


def rate_classes(text: str) -> list[int]:
    """``(0 1 2 2 3 4)`` to the class of each exchange rate AC AG AT CG CT GT."""
    out = [int(x) if x.isdigit() else ord(x.lower()) for x in text.strip("() ").split()]
    if len(out) != 6:
        raise ValueError("six classes are needed")
    return out


def model_parameters(text: str) -> dict[str, dict[str, list[float]]]:
    """Parameter lines such as ``M1 r 1 2 1 1 2 1 e .25 .25 .25 .25 a .5 p .2`` and ``S 0.5 1.5``: by tag of the subset (M1
    where there is none, S for the subsets' rates) the values of each letter; those of S have no letter."""
    out: dict[str, dict[str, list[float]]] = {}
    tag, key = "M1", None
    for token in text.replace(";", " ").split():
        if re.fullmatch(r"[mM]\d+", token):
            tag, key = token.upper(), None
        elif token in ("S", "s") and (key is None or tag != "S"):
            tag, key = "S", ""
            out.setdefault("S", {}).setdefault("", [])
        elif token.isalpha():
            if tag == "S":
                tag = "M1"
            key = token.lower()
            out.setdefault(tag, {}).setdefault(key, [])
        elif key is None:
            raise ValueError(f"a value without a letter: {token}")
        else:
            out[tag][key].append(float(token))
    return out


def recorded(text: str) -> list[dict]:
    """What tree lines have in brackets: name, tree, and where given the score and the model's parameters."""
    found = []
    for m in re.finditer(r"\b[uU]?[tT][rR][eE][eE]\s+\*?\s*(\S+)\s*=\s*((?:\[[^\]]*\]\s*)*)(\(.*?;)", text, re.S):
        score, model = re.search(r"[Ss]core\s+(-?[\d.]+)", m[2]), re.search(r"[Mm]odel\s+([^\]]*)\]", m[2])
        found.append({"name": m[1], "newick": re.sub(r"\[[^\]]*\]", "", m[3]), "score": float(score[1]) if score else None, "parameters": model_parameters(model[1]) if model else {}})
    return found


@dataclass(frozen=True)
class Constraint:
    """A split that trees must have, or with ``positive`` False must not have; ``mask`` has the taxa that count."""

    split: int
    positive: bool
    mask: int


def parse_constraints(text: str, taxa: list[str]) -> list[Constraint]:
    """Lines of a sign and a Newick tree, or a sign and a string of ``*`` and ``.``; taxa that are left out
    of a tree do not count. Splits are given on the side of the first taxon that counts."""
    from .newick import parse_newick

    bit, out = {t: 1 << i for i, t in enumerate(taxa)}, []
    for line in filter(None, map(str.strip, text.splitlines())):
        sign, body = line[0], line[1:].strip()
        if sign not in "+-":
            raise ValueError(f"a constraint must begin with + or -: {line}")
        if set(body) <= {"*", ".", "-"}:
            if len(body) != len(taxa):
                raise ValueError("a constraint of another number of taxa")
            found, mask = [sum(1 << i for i, x in enumerate(body) if x == "*")], (1 << len(taxa)) - 1
        else:
            tree = parse_newick(body if body.endswith(";") else body + ";", {str(i + 1): t for i, t in enumerate(taxa)})
            below = [bit.get(x, 0) if x else 0 for x in tree.label]
            for v in reversed(range(1, len(tree.parent))):
                below[tree.parent[v]] |= below[v]
            mask = below[0]
            inner = [v for v, kids in enumerate(tree.children()) if kids and v]
            found = [below[v] for v in inner]
        first = mask & -mask
        for s in found:
            s = s if s & first else mask ^ s
            if bin(s).count("1") > 1 and bin(mask ^ s).count("1") > 1:
                out.append(Constraint(s, sign == "+", mask))
    return list(dict.fromkeys(out))


def satisfies(splits: frozenset[int], constraint: Constraint) -> bool:
    """Whether a tree's splits (on the side of the first taxon) satisfy a constraint, backbones included."""
    first = constraint.mask & -constraint.mask
    seen = {x if x & first else constraint.mask ^ x for x in (s & constraint.mask for s in splits)}
    return (constraint.split in seen) == constraint.positive
