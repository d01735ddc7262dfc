import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave.llm import kernels as K
from hostweave.llm import langid, toxicity

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(DOCS)
    want = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.identify(docs).collect()
    assert len(out) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r.lang_pred == want[r.doc_id] for r in out if r.held_out]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_predictions_depend_on_the_text_alone(spark):
    docs = spark.read.parquet(DOCS).limit(300)
    model = langid.fit(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source", "1 AS p"), model).collect()}
    assert a == b


def test_language_id_odd_rows(spark):
    S = "doc_id long, text string, lang string"
    rows = [(i, "le la de que eau" if i % 2 else "the of and ing", "fr" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !!! \n", None), (103, "eau " * 60_000, None), (None, "the and", "en"), (104, "the and of", None), (104, "the and of", None)]
    out = langid.identify(spark.createDataFrame(rows + odd, S)).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[103].lang_pred == "fr" and by[104].lang_pred == "en" and not by[None].held_out
    assert langid.identify(spark.createDataFrame([], S)).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None)], S)).collect()} == {"und"}


def plain_grams(text):
    """n-grams of 1 to MOST characters, by position, hashed with plain integers."""
    other = lambda c: ord(c) < 97 or 122 < ord(c) < 192
    t = re.sub(" +", " ", "".join(" " if other(c) else c for c in f" {text.lower()} "))
    found = Counter()
    for i in range(len(t)):
        h = 0
        for k in range(langid.MOST):
            if i + k < len(t):
                h = (h + ord(t[i + k])) * int(langid._MULTIPLIERS[k]) & 0xFFFFFFFF
                h ^= h >> 15
                found[h % langid.FEATURES] += 1
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000, 1 << 20])
def test_blocks_have_no_seam(size):
    rng = np.random.default_rng(size)
    for text in ["", " ", "a", "ab", "abc", "Été !! 12 x", "  lead and trail  ", "".join(rng.choice(list("abc dé-\U0001f600"), 3000 if size > 2 else 300))]:
        assert Counter(np.concatenate(list(langid.blocks(text, size))).tolist()) == plain_grams(text)


def test_predictions_against_plain_sums(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs)
    for r in docs.where("doc_id % 100 = 3").collect():
        found = plain_grams(r.text)
        z = [(model.bias[j] + sum(n * model.weights[f, j] * model.idf[f] for f, n in found.items()) / sum(found.values())) / model.temperature for j in range(len(model.languages))]
        lang, score = model.predict(r.text)
        e = np.exp(np.array(z) - max(z))
        assert lang == model.languages[int(np.argmax(z))] and score == pytest.approx(e.max() / e.sum(), abs=1e-4)


def test_numerals_are_no_letters():
    model = langid.Model(["en"], np.ones(langid.FEATURES), np.zeros((langid.FEATURES, 1)), np.zeros(1), 1.0)
    assert [model.predict(x)[0] for x in ("½²", "Ⅷ", "①", "١٢", "_", "...", "a", "中", "ª", "2 º")] == ["und"] * 6 + ["en"] * 4


def test_toxicity_against_labels(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(DOCS.replace("documents", "labels"))
    want = {r.doc_id: r.toxic for r in labels.collect()}
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    hits = [out[i].toxic == bool(y) for i, y in want.items()]
    assert np.mean(hits) > 0.98


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    features, y = [], []
    for _ in range(600):
        a = int(rng.integers(2))
        ids = {int(x) for x in rng.integers(100, 400, 12)} | ({1} if a else set())
        features.append(np.array(sorted(ids)))
        y.append([a, a])
    found = toxicity.train_chain(features, np.array(y), np.arange(600) % toxicity.FOLDS)
    chain = found.models
    assert 0 < found.threshold < 1
    assert len(chain[1].chain) == 1 and chain[1].chain[0] > 0 and chain[0].weights[1] > 0
    # the word weighs less in the second model, as the first one's probability says it already
    assert chain[1].weights[1] < chain[0].weights[1]


def test_toxicity_on_rows_that_it_has_not_seen(spark):
    docs = spark.read.parquet(DOCS.replace("sf0.01", "sf0.1"))
    labels = spark.read.parquet(DOCS.replace("sf0.01/documents", "sf0.1/labels"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 > 0
    as_text = F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id")  # ids of any type
    out = toxicity.classify(docs.select(as_text, "text"), labels.where(seen).select(as_text, "quality", "toxic")).withColumnRenamed("toxic", "said")
    rows = out.join(labels.where(~seen).select(as_text, "toxic"), "doc_id").collect()
    hit = [r.said for r in rows if r.toxic]
    wrong = [r.said for r in rows if not r.toxic]
    assert len(hit) > 90 and np.mean(hit) > 0.8 and np.mean(wrong) < 0.02


def test_probabilities_against_plain_sums(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(DOCS.replace("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    one = lambda w: int(K.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), K.PUNCTUATION)[0][0]) % toxicity.FEATURES
    got = {r.doc_id: (r.p_low_quality, r.p_toxic, r.toxic) for r in toxicity.classify(docs, labels).collect()}
    for r in docs.where("doc_id % 50 = 1").collect():
        words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", r.text.encode())
        ids = {one(w[:n]) for w in words for n in (len(w), *toxicity.BEGINNINGS)}
        before = []
        for m in chain.models:
            z = m.bias + sum(m.weights[i] for i in ids) + sum(c * x for c, x in zip(m.chain, before, strict=True))
            before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert got[r.doc_id][:2] == pytest.approx(before, abs=1e-6) and got[r.doc_id][2] == (before[1] >= chain.threshold)


def test_best_threshold():
    p, y = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_threshold(p, y, np.ones(5)) == pytest.approx(0.2)
    assert toxicity.best_threshold(p, y, np.array([1, 1, 50, 1, 1])) == pytest.approx(0.85)
    assert toxicity.best_threshold(p, np.ones(5, int), np.ones(5)) == 0.5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 40_000), (None, "idiot"), (4, "x"), (4, "x")], "doc_id long, text string").selectExpr("*", "1 AS toxic")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (4, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).count() == 6 and not any(r.toxic for r in toxicity.classify(docs, labels).collect() if r.doc_id in (1, 2))
    assert not any(r.toxic for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0
