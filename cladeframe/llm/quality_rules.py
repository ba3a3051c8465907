"""Quality rules: a learned decision list over text statistics, applied as one conditional expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, blank_words, gram_hashes, word_hashes

WINDOW = 5
#: What conditions may test. All are ratios, so that they mean the same for short and long texts.
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "shout_share", "exclaim_share", "digit_share", "words_per_line")


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, counts over the whole text, and the ratios in FEATURES.

    A null text has no words; its counts are 0 and its ratios 0. Other columns are not carried.
    """
    text, c = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), blank_words(text).alias("w"))
    d = d.select("*", word_hashes(c("w")).alias("h"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", gram_hashes("h", WINDOW).alias("g"), F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("h")).alias("n_distinct"), F.regexp_count("t", F.lit(r"[A-Z]{2,}")).alias("n_shout"), F.regexp_count("t", F.lit("!")).alias("n_exclaim"), F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"),
    )
    # Windows that occur twice or more: equal neighbours among all (hash, start) in order. Most texts have none.
    twice = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("sorted", F.when(twice, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("at"))))))
    same = lambda x, i, by: F.coalesce(F.get("sorted", i + by)["g"] == x["g"], F.lit(False))
    d = d.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["at"])))
    steps = F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(WINDOW), lambda total, i: total + F.least(F.lit(WINDOW), F.get("at", i) - F.get("at", i - 1)))
    d = d.withColumn("n_repeat_words", F.when(F.size("at") > 1, steps).otherwise(0).cast("long"))
    per = lambda x, of: F.when(c(of) > 0, c(x) / c(of)).otherwise(0.0)
    ratios = {"chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"), "shout_share": per("n_shout", "n_words"), "exclaim_share": per("n_exclaim", "n_words"), "digit_share": per("n_digits", "word_chars"), "words_per_line": per("n_words", "n_lines")}
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[v.alias(k) for k, v in ratios.items()])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the condition of the highest information gain until no good text is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            values = np.unique(np.quantile(x[inside, k], np.linspace(0, 1, cuts)))
            for t in (values[1:] + values[:-1]) / 2:
                above = x[:, k] >= t
                for up in (True, False):
                    now = inside & (above == up)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    if p1 and (g := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > gain:
                        best, gain = Condition(name, up, float(t)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, apart: np.ndarray, *, most_rules: int = 8, most_conditions: int = 4, cuts: int = 33, precision: float = 0.95) -> list[Rule]:
    """Sequential covering: grow a rule on the rows that are not ``apart``, prune its last conditions on
    those that are, keep it if it is right there at ``precision``, take away what it covers, go on."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad).any():
        grown = left & ~apart
        rule = _grow(x[grown], bad[grown], most_conditions, cuts)
        if not rule:
            break
        check = left & apart

        def worth(r: Rule) -> float:
            got = _covers(r, x) & check
            p, n = (got & bad).sum(), (got & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        got = _covers(rule, x) & left
        p, n = (got & bad & (apart | ~apart.any())).sum(), (got & ~bad & (apart | ~apart.any())).sum()
        if not p or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~got
    return rules


def train_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, **learn) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents, picked by a hash of the id; quality 0 is what rules reject.

    Ids may have any type; ``labels`` has them in a column of the same name. Rows whose id or quality is null teach
    nothing; of several labels of an id the least counts. The sample's ids are the only broadcast; its size is the bound.
    A third of the rows, by another hash, is kept apart for pruning.
    """
    c = F.col
    labels = labels.select(c(id_col).alias("label_id"), c("quality").alias("quality"))
    picked = labels.where(c("label_id").isNotNull() & c("quality").isNotNull()).groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    slim = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text"))
    slim = slim.join(F.broadcast(picked.select("label_id")), c("doc_id") == c("label_id"), "left_semi")
    rows = text_statistics(slim).join(F.broadcast(picked), c("doc_id") == c("label_id"))
    rows = rows.select((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("apart"), "quality", *FEATURES).orderBy("doc_id", *FEATURES).collect()
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    bad = np.array([r["quality"] == 0 for r in rows])
    apart = np.array([r["apart"] for r in rows])
    return learn_rules(x, bad, apart, **learn)


def apply_rules(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed``, ``rule`` (the first rule that holds, else null) and ``kept``."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), " and ".join(map(str, rule))).otherwise(verdict)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = statistics.withColumn("base_failed", failed).withColumn("rule", verdict)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **train) -> DataFrame:
    """Statistics and verdict for all rows. Without labelled rows only the base rule decides.

    Repeated rows give repeated results; an empty table gives none; null texts fail the base rule.
    """
    return apply_rules(text_statistics(docs, id_col=id_col, text_col=text_col), train_rules(docs, labels, id_col=id_col, text_col=text_col, **train))
