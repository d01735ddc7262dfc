"""Toxicity (10): a classifier chain over label categories, trained with out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import kernels as K
from hostweave.llm.common import small_batches, unit, within

#: Hashed features; labelled documents that the chain is fitted on (expected number); folds.
FEATURES, SAMPLE, FOLDS = 1 << 18, 8000, 4
#: Besides whole words, their beginnings of that many bytes: forms of one stem share them.
BEGINNINGS = (4, 6, 8)
EPOCHS, ALPHA, BETA, L1, L2 = 12, 1.5, 1.0, 1.5, 0.05
#: label category -> SQL of its 0 or 1 in the table of labels, in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each whole text's distinct hashed words, of letters, digits and bytes beyond ASCII, and their beginnings."""
    for _, data, offsets in K.utf8_chunks(texts):
        parts = [K.word_hashes(data, offsets, K.PUNCTUATION, n) for n in (None, *BEGINNINGS)]
        at = parts[0][1].tolist()
        ids = [(words % np.uint64(FEATURES)).astype(np.int64) for words, _ in parts]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(np.concatenate([x[a:b] for x in ids]))


@dataclass
class Linear:
    weights: np.ndarray
    chain: np.ndarray  # of the logits of the categories before
    bias: float

    def logit(self, ids: np.ndarray, before: list[float]) -> float:
        return float(self.bias + self.weights[ids].sum() + sum(c * x for c, x in zip(self.chain, before, strict=True)))


def train_linear(examples: list[tuple[np.ndarray, list[float], int]], n_before: int, seed: int = 1) -> Linear:
    """Logistic regression by follow-the-regularised-leader; the L1 penalty leaves weights to few words."""
    size = FEATURES + n_before + 1
    z, q = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[FEATURES:] = 0
    last = np.arange(FEATURES, size)
    rng = np.random.default_rng(seed)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(q[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            ids, before, y = examples[k]
            i = np.concatenate([ids, last])
            x = np.ones(len(i))
            x[len(ids) : len(ids) + n_before] = before
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(q[i] + g * g) - np.sqrt(q[i])) / ALPHA
            z[i] += g - sigma * w
            q[i] += g * g
    w = weights(slice(None))
    return Linear(w[:FEATURES].astype(np.float64), w[FEATURES : FEATURES + n_before], float(w[-1]))


def squash(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Chain:
    models: list[Linear]
    threshold: float  # of the last category

    def probabilities(self, ids: np.ndarray) -> list[float]:
        before: list[float] = []
        for model in self.models:
            before.append(squash(model.logit(ids, before)))
        return before


def out_of_fold(examples: list[tuple[np.ndarray, list[float], int]], folds: np.ndarray, n_before: int, shift: float) -> np.ndarray:
    """Each example's probability by a model that wasn't trained on it."""
    out = np.zeros(len(examples))
    for fold in range(FOLDS):
        model = train_linear([e for e, k in zip(examples, folds, strict=True) if k != fold], n_before)
        model.bias += shift
        for i in np.flatnonzero(folds == fold):
            out[i] = squash(model.logit(*examples[i][:2]))
    return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of largest F1 over the weighted rows, in the middle of its gap; 0.5 with one class only."""
    if len(set(y.tolist())) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, tried = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order])
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal probabilities are taken together
    f1 = np.where(last, 2 * hits / (tried + (weight * y).sum()), 0)
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def train_chain(features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, weight: np.ndarray | None = None) -> Chain:
    """labels: rows x categories. A later model sees the earlier ones' probabilities for rows they weren't trained on; so does the last one's threshold.

    weight: how many rows a drawn one stands for. Models are trained on the rows as drawn, and their biases then moved by
    the odds that the draw has changed.
    """
    weight = np.ones(len(features)) if weight is None else weight
    before: list[list[float]] = [[] for _ in features]
    models, threshold = [], 0.5
    for j in range(labels.shape[1]):
        y = labels[:, j]
        examples = [(f, list(b), int(v)) for f, b, v in zip(features, before, y, strict=True)]
        odds = lambda w: (w[y == 1].sum() + 0.5) / (w[y == 0].sum() + 0.5)
        shift = float(np.log(odds(weight)) - np.log(odds(np.ones(len(y)))))
        model = train_linear(examples, j)
        model.bias += shift
        models.append(model)
        apart = out_of_fold(examples, folds, j, shift)
        if j + 1 < labels.shape[1]:
            for b, p in zip(before, apart.tolist(), strict=True):
                b.append(p)
        else:
            threshold = best_threshold(apart, y, weight)
    return Chain(models, threshold)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE) -> Chain | None:
    """Fits the chain on an expected `sample` of labelled documents, drawn by a hash of doc_id, evenly from those with and without the last category. Rows without all labels or without text aren't used.

    The driver gets their hashed features, at most FEATURES numbers a row, and no texts.
    """
    small_batches(docs.sparkSession)
    last = f"y_{list(categories)[-1]}"
    known = labels.select("doc_id", *[F.expr(x).cast("int").alias(f"y_{k}") for k, x in categories.items()]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(f"y_{k}").alias(f"y_{k}") for k in categories])
    n = {bool(r[0]): r[1] for r in known.groupBy(F.col(last) > 0).count().collect()}
    rates = {k: min(1.0, sample / len(n) / v) for k, v in n.items()}
    rate = F.when(F.col(last) > 0, rates.get(True, 0.0)).otherwise(rates.get(False, 0.0))
    drawn = known.withColumn("_rate", rate).where(unit(F.lit(23), "doc_id") < F.col("_rate"))
    names = [f"y_{k}" for k in categories]
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(within(drawn), "doc_id").select("text", F.xxhash64("doc_id").alias("hash"), "_rate", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.astype("<i4").tobytes() for x in text_features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=["ids", *batch.schema.names[1:]])

    got = texts.mapInArrow(run, "ids binary, hash long, _rate double, " + ", ".join(f"{c} int" for c in names)).collect()
    rows = sorted(got, key=lambda r: (r.hash, bytes(r.ids)))
    if not rows:
        return None
    y = np.array([[r[c] for c in names] for r in rows])
    folds = np.array([r.hash % FOLDS for r in rows])
    return train_chain([np.frombuffer(r.ids, "<i4").astype(np.int64) for r in rows], y, folds, np.array([1 / r["_rate"] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, p_<category> in the chain's order, toxic (the last category's p >= threshold, by default that of the largest F1 out of fold).

    Whole texts are read. A null text, one without words, and any text where nothing could be learned have probability 0
    for all categories and aren't toxic. Repeated rows get equal results, labels that repeat a doc_id count once with the
    largest values, an empty table gives an empty result, and other columns are ignored. Ids of any type will do.
    """
    chain = fit(docs, labels, categories)
    sc, names = docs.sparkSession.sparkContext, list(categories)
    sent = sc.broadcast(chain)
    least = threshold if threshold is not None else chain.threshold if chain else 0.5
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            out, some = np.zeros((len(names), len(batch))), np.zeros(len(batch), dtype=bool)
            for i, ids in enumerate(text_features(batch.column(1))):
                if chain and len(ids):
                    out[:, i], some[i] = chain.probabilities(ids), True
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in out], pa.array(some & (out[-1] >= least))], names=["doc_id", *[f"p_{k}" for k in names], "toxic"])

    schema = "doc_id {}, {}, toxic boolean".format(docs.schema["doc_id"].dataType.simpleString(), ", ".join(f"p_{k} double" for k in names))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
