"""Language ID (6): sparse multinomial logistic regression on TF-IDF character n-grams, by follow-the-regularised-leader."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm.common import small_batches, unit

#: Hashed features; n-grams of 1 to MOST characters within words, with the word's edges.
FEATURES, MOST = 1 << 15, 3
#: Labelled rows that the classifier is fitted on, all languages together (expected number). Document frequencies come from all.
SAMPLE = 3000
#: Passes over the sample; follow-the-regularised-leader's rate, smoothing, and elastic-net penalties.
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.02, 0.05
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


#: Characters of a text that are hashed at once.
BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; numerals such as a roman or circled one aren't."""
    return any(map(str.isalpha, text))


def blocks(text: str, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Feature of every character n-gram position of the whole text; runs of what isn't a letter are one edge character.

    A long text comes in blocks, for bounded memory. A block begins with the last characters of the one before, and only
    n-grams that end in it are counted, so blocks together give what the text as one gives.
    """
    text = text.lower()
    tail = np.array([32], dtype=np.uint32)  # the edge before the first character
    fresh = 0  # characters of tail whose n-grams were counted
    for at in range(0, max(1, len(text)), size):
        points = np.frombuffer(text[at : at + size].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where((points < 97) | ((points > 122) & (points < 192)), np.uint32(32), points)
        if at + size >= len(text):
            points = np.append(points, np.uint32(32))
        keep = (points != 32) | (np.concatenate([tail[-1:], points[:-1]]) != 32)
        points = np.concatenate([tail, points[keep]]).astype(np.uint32)
        out, h = [], np.zeros(len(points), dtype=np.uint32)
        for k in range(MOST):
            h = (h[: len(points) - k] + points[k:]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            out.append((h % np.uint32(FEATURES))[max(0, fresh - k) :])
        yield np.concatenate(out).astype(np.int64)
        tail = points[1 - MOST :]
        fresh = len(tail)


def grams(text: str) -> np.ndarray:
    return np.concatenate(list(blocks(text)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x languages, with most rows zero
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        """TF is a feature's share of the n-grams, so the sum over positions is the dot product."""
        total, n = np.zeros(len(self.languages)), 0
        for g in blocks(text):
            total += self.scaled[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return (self.bias + total / max(1, n)) / self.temperature

    def __post_init__(self):
        self.scaled = (self.weights * self.idf[:, None]).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        z = self.logits(text)
        e = np.exp(z - z.max())
        best = int(e.argmax())
        return self.languages[best], float(e[best] / e.sum())


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and how often each occurs."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for g in blocks(text):
        total += np.bincount(g, minlength=FEATURES)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], languages: list[str], idf: np.ndarray, seed: int = 5) -> Model:
    """rows: features, their counts, language. Per-coordinate FTRL-proximal on the softmax loss; a fifth of the rows is kept out for the temperature."""
    n = len(languages)
    rng = np.random.default_rng(seed)
    examples = [(ids, (counts / counts.sum() * idf[ids]).astype(np.float64), languages.index(lang)) for ids, counts, lang in rows]
    order = rng.permutation(len(examples))
    kept_out, fitted = order[: len(order) // 5], order[len(order) // 5 :]
    z, q, bias = np.zeros((FEATURES, n)), np.zeros((FEATURES, n)), np.zeros(n)

    def weights(ids: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[ids]) <= L1, 0.0, -(z[ids] - np.sign(z[ids]) * L1) / ((BETA + np.sqrt(q[ids])) / ALPHA + L2))

    scale = 30.0  # shares of n-grams are small numbers
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            ids, values, y = examples[i]
            w, x = weights(ids), values * scale
            logits = bias + x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(q[ids] + g * g) - np.sqrt(q[ids])) / ALPHA
            z[ids] += g - sigma * w
            q[ids] += g * g
            bias -= 0.05 * p
    model = Model(languages, idf, weights(slice(None)) * scale, bias, 1.0)
    best, lowest = 1.0, math.inf
    if len(kept_out):
        logits = np.array([model.bias + values @ model.weights[ids] for ids, values, _ in (examples[i] for i in kept_out)])
        y = np.array([examples[i][2] for i in kept_out])
        for t in np.geomspace(0.05, 20, 60):
            s = logits / t
            s -= s.max(axis=1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
            if loss < lowest:
                best, lowest = float(t), loss
    return Model(languages, idf, model.weights, bias, best)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            mask = np.zeros(FEATURES, dtype=bool)
            for g in blocks(text.as_py() or ""):
                mask[g] = True
            seen += mask
            n += 1
    ids = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, FEATURES).astype(np.int32)), pa.array(np.append(seen[ids], n))], names=["feature", "documents"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text, lang: the distinct features and counts instead of the text."""
    for batch in batches:
        found = [counted(x.as_py()) for x in batch.column(0)]
        lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], names=["ids", "counts", "lang"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows whose lang and text aren't null and whose crc32(doc_id) mod 3 isn't 1.

    Document frequencies count all of them; the classifier is fitted on an expected `sample` of them, spread evenly over
    the languages and drawn by a hash of doc_id and text length. The driver gets their distinct features, at most
    FEATURES a row, and no texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    found = rows.select("text").mapInArrow(_frequencies, "feature int, documents long").groupBy("feature").agg(F.sum("documents").alias("documents")).toPandas()
    n = int(found.loc[found.feature == FEATURES, "documents"].iloc[0])
    frequency = np.zeros(FEATURES)
    words = found[found.feature < FEATURES]
    frequency[words.feature.to_numpy()] = words.documents.to_numpy()
    idf = np.log((1 + n) / (1 + frequency)) + 1
    rates = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / len(languages) / counts[k])))])
    drawn = rows.where(unit(F.lit(11), "doc_id", F.length("text")) < rates[F.col("lang")])
    picked = drawn.select("text", "lang").mapInArrow(_counts, "ids array<long>, counts array<long>, lang string").collect()
    picked = sorted(((r.lang, r.ids, r.counts) for r in picked))  # an order that is the texts' own
    return train([(np.array(ids), np.array(counts), lang) for lang, ids, counts in picked], languages, idf)


def predict_column(model: Model, text: str = "text") -> Column:
    """A struct of lang_pred and score for each text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([model.predict(x) for x in s], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is a language seen in training, or `und` with score 0 where text is null or has no letter, or nothing could
    be learned. Ties go to the language that is first by code point. Whole texts are read, in blocks where they are long.
    Rows that repeat get equal results, a null doc_id isn't held out, an empty table gives an empty result and other
    columns are ignored. Predictions depend on the text alone.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text").withColumn("p", predict_column(model))
    return out.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")
