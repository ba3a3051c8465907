"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_texts
from .scratch import small_batches

#: A letter is a character of the Unicode categories L*.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds and penalties of the training. ``sample_rows`` bounds the labelled rows that are fitted;
    document frequencies are counted over all training rows."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    sample_rows: int = 6000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.2


def features(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed character n-grams of the whole lower-cased text, one for each occurrence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, code, mix = [], np.zeros(len(points), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * mix
        code ^= code >> np.uint64(29)
        if n in orders:
            out.append(((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.array([], np.int32)


@dataclass
class Model:
    """``table`` has IDF times weight for each feature and language, ``bias`` and ``temperature`` the rest."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        got = features(text, self.settings.orders, self.settings.bits)
        # The counts of a long text, so that no table of all its grams is made.
        total = self.table[got].sum(0, dtype=np.float64) if len(got) < len(self.table) else np.bincount(got, minlength=len(self.table)) @ self.table
        logits = (self.bias + total / max(1, len(got))) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net. rows: features, their TF-IDF values, the language."""
    z, n = np.zeros((size + 1, n_languages)), np.zeros((size + 1, n_languages))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= s.l1, 0.0, -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, value, y = rows[i]
            w = weights(at)
            g = _softmax(value @ w)
            g[y] -= 1
            grad = value[:, None] * g
            square = grad * grad
            z[at] += grad - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / s.alpha * w
            n[at] += square
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows (doc_id, text, lang); rows without a letter or without a language teach nothing.

    Languages and document frequencies are counted over all rows. The regression is fitted on at most
    ``sample_rows`` distinct texts, shared equally among the languages, those of the least hashes; a
    fifth of them is kept apart to fit the temperature. TF is a gram's share of all grams of its text.
    """
    s, spark = settings, labelled.sparkSession
    size = 1 << s.bits
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((size, 0)), np.zeros(0), 1.0, s)

    def document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total[np.unique(features(text, s.orders, s.bits))] += 1
                n += 1
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"feature": np.append(seen, -1), "n": np.append(total[seen], n)})

    with small_batches(spark):
        df = rows.select("text").mapInPandas(document_frequency, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    n_docs = int(df.loc[df.feature == -1, "n"].sum())
    df = df[df.feature >= 0]
    idf = np.zeros(size)
    idf[df.feature.to_numpy()] = np.log((1 + n_docs) / (1 + df.n.to_numpy())) + 1

    # Of each language the texts of the least hashes, equal ones once. The filter leaves a little more than are
    # taken, so that the sort behind it has a bounded number of rows.
    each, buckets = max(1, s.sample_rows // len(languages)), 1 << 30
    h = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(buckets))
    texts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.05)).collect()}
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(buckets * min(1.0, 1.5 * (each + 20) / max(1, texts[k])))))])
    some = rows.withColumn("h", h).where(F.col("h") <= share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    scale = math.sqrt(size)
    fit, apart = [], []
    for text, lang, k in some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("text", "lang", "h").orderBy("h", "lang").toLocalIterator():
        if LETTER.search(text):
            at, tf = np.unique(features(text, s.orders, s.bits), return_counts=True)
            value = tf / tf.sum() * idf[at] * scale
            row = (np.append(at, size), np.append(value, 1.0), languages.index(lang))
            (apart if (k * 2654435761) % 1000 < 1000 * s.calibration_share else fit).append(row)
    weight, bias = _fit(fit or apart, len(languages), size, s)
    logits = [(bias + v[:-1] @ weight[a[:-1]], y) for a, v, y in apart]

    def loss(t: float) -> float:
        return -sum(math.log(max(1e-12, _softmax(z / t)[y])) for z, y in logits)

    grid = [2.0**e for e in np.arange(-4, 4.01, 0.25)]
    temperature = min(grid, key=loss) if logits else 1.0
    return Model(languages, (weight * idf[:, None] * scale).astype(np.float32), bias, temperature, s)


def held_out(doc_id) -> F.Column:
    """A quarter of the documents, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for all rows; a text that is null or has no letter is ``und`` with score 0.

    Only the text decides a prediction. Repeated rows give repeated results, an empty table gives
    none, other columns are not carried. If no training row has a language, all rows are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def predict(texts: list) -> dict:
            got = [m.predict(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return predict

    return map_texts(docs, id_col, text_col, make, {"lang_pred": "string", "score": "double"}, {"held_out": held_out(F.col(id_col))})


def identify_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the documents that are not held out, then predict all."""
    return identify(docs, train(docs.where(~held_out(F.col("doc_id"))), settings))
