"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; a binary classifier over hashed
character n-grams (1 to 3 bytes of the lower-cased text) learns each bit.
A whole text's margins are decoded by weighted loss: a bit counts for a
language as much as its classifier was right on that language in training.
The nearest codeword wins; a runner-up within ``margin`` flags ambiguity.

The classifiers are fitted on at most ``sample_rows`` different labelled
texts, spread evenly over all languages, or one of each where there are more
languages than that, so none is left out; a fitted row takes 16 KB of the
driver. n-gram counts come from whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if there is no labelled row. A text of any length is read
whole; of equally near codewords the first language by name wins; repeated
rows are judged alike, and copies of a text are learnt from once. With one language all others are
that language with score 1. Ids are carried as they are; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def grams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the lower-cased text's bytes, padded with blanks."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([b * np.uint32(0x165667B1) >> np.uint32(20), two >> np.uint32(20), three >> np.uint32(20)])


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """An exhaustive code for up to six classes, else the best of 200 random dense codes."""
    if n <= 6:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits).T.reshape(n, -1)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tried = [rng.choice((-1, 1), size=(n, width)) for _ in range(max(1, min(200, 10**8 // n**2 // 2)))]  # thousands of classes: one, as comparing takes their square
    if len(tried) == 1:
        return tried[0]
    return max(tried, key=lambda m: ((m @ m.T - 9999 * np.eye(n)).max() * -1))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights for each column of ``y`` (+1, -1), by Adam on the logistic loss."""
    w, m, v = (np.zeros((x.shape[1], y.shape[1]), dtype=np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))
        g = x.T @ pull.astype(np.float32) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class LanguageModel:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, margin: float):
        self.langs, self.code, self.weights, self.bias, self.trust, self.margin = langs, code, weights, bias, trust, margin

    @classmethod
    def fit(cls, langs: list[str], label: np.ndarray, x: np.ndarray, margin: float) -> LanguageModel:
        if len(langs) < 2:
            return cls(langs, np.zeros((len(langs), 0)), np.zeros((BINS, 0), np.float32), np.zeros(0), np.zeros((len(langs), 0)), margin)
        code = codewords(len(langs))
        scale = x.std(axis=0) + np.float32(1e-4)
        centre = x.mean(axis=0)
        y = code[label].astype(np.float32)
        scaled = (x - centre) / scale / np.float32(np.sqrt(BINS))
        w = _logistic(np.concatenate([scaled, np.ones((len(x), 1), np.float32)], axis=1), y)
        right = (scaled @ w[:-1] + w[-1]) * y > 0
        trust = np.stack([right[label == c].mean(axis=0) if (label == c).any() else np.ones(code.shape[1]) for c in range(len(langs))])
        weights = (w[:-1] / scale[:, None] / np.float32(np.sqrt(BINS))).astype(np.float32)
        return cls(langs, code, weights, w[-1] - centre @ weights, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9), margin)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for a in range(0, len(text), 1 << 20):  # a whole text, in pieces of bounded memory
            g = grams(text[a : a + (1 << 20)])
            total, n = total + np.bincount(g, minlength=BINS).astype(np.float32) @ self.weights, n + len(g)
        z = np.clip(total / n + self.bias, -20, 20)
        loss = (self.trust * np.log1p(np.exp(-self.code * z))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss.min()) * 2)
        return self.langs[order[0]], float(p[order[0]] / p.sum()), bool(loss[order[1]] - loss[order[0]] < self.margin)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000, margin: float = 0.2) -> LanguageModel:
    """A model of at most ``sample_rows`` rows, or one a language, where ``learn`` holds and text and language are not null."""
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"))
    counts = {r.lang: r.texts for r in found.collect()}  # one number a language
    langs = sorted(counts)
    if not langs:
        return LanguageModel.fit([], np.zeros(0, int), np.zeros((0, BINS), np.float32), margin)
    each = max(1, sample_rows // len(langs))
    # Different texts are drawn, about twice as many as needed, so that only these are sorted and copies crowd out nothing.
    least = {lang: min((1 << 63) - 1, int((4.0 * each / max(1, counts[lang]) - 1) * (1 << 63))) for lang in langs}
    drawn = F.broadcast(docs.sparkSession.createDataFrame(list(least.items()), "lang string, least long"))  # a row a language
    # The least text of a language is drawn in any case: few texts may all lie beyond a threshold.
    first = rows.groupBy("lang").agg(F.min_by("text", "h").alias("text"), F.min("h").alias("h"))
    rows = rows.join(drawn, "lang").where("h <= least").select("text", "lang", "h").unionByName(first.select("text", "lang", "h")).dropDuplicates(["lang", "h"])
    by = Window.partitionBy("lang").orderBy("h")
    sample = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= each).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shares = [], []
            for t in b.column("text").to_pylist():
                n = np.bincount(grams(t), minlength=BINS)
                at = np.flatnonzero(n)
                ids.append(at)
                shares.append(n[at] / n.sum())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "at", "share"])

    got = sample.mapInArrow(count, "lang string, at array<int>, share array<float>").toArrow()
    x, label, number = np.zeros((got.num_rows, BINS), dtype=np.float32), np.zeros(got.num_rows, dtype=int), {lang: k for k, lang in enumerate(langs)}
    for i in range(got.num_rows):
        x[i, got["at"][i].values.to_numpy()] = got["share"][i].values.to_numpy()
        label[i] = number[got["lang"][i].as_py()]
    return LanguageModel.fit(langs, label, x, margin)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row of ``docs``; only the text is looked at."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
