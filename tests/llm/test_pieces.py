import numpy as np
import pytest

from hostweave.llm import pieces as P

S = "doc_id long, text string"
ODD = [None, "", " ", "   \n\t x", "▁ literal ▁▁", "naïve \U0001f9ff́ 中文字", "<0x0A> <s>", "a" * 30_000, "  two  spaces ", "\x00\x01", "x\r\ny"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


def brute(v, names, text):
    """Plain Viterbi by dictionary, over the whole text at once."""
    marked = [(c if c != " " else P.MARK) if c != P.MARK else None for c in text]
    best, back = [0.0] + [-1e18] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if None in marked[i:j]:
                break
            k = names.get("".join(marked[i:j]))
            if k is not None and best[i] + v.scores[k] > best[j]:
                best[j], back[j] = best[i] + v.scores[k], (i, k)
        if (marked[i] is None or marked[i] not in names) and best[i] + v.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + v.unknown, (i, None)
    return best[-1]


def score(v, ids):
    """Of ids; the bytes of one character count as one unknown character."""
    total, tokens = 0.0, list(ids)
    of = {k: b for b, k in enumerate(v.byte_ids)}
    for k in tokens:
        if k in of:
            total += v.unknown if of[k] < 0x80 or of[k] >= 0xC0 else 0
        else:
            total += v.scores[k]
    return total


def test_best_score_and_round_trip(vocabulary):
    import duckdb
    import sentencepiece

    v = vocabulary
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL_FILE)
    names = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()] + [x for x in ODD if x and len(x) < 100]
    for text, ids in zip(texts, v.encode_many(texts), strict=True):
        assert v.decode(ids) == text
        assert score(v, ids.tolist()) == pytest.approx(brute(v, names, text), abs=1e-6)


def test_double_array_finds_what_is_in_it():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "日本", "zz"])}
    t = P.DoubleArray(words)
    for w, i in words.items():
        s = 0
        for c in w:
            assert t.check[t.base[s] + c] == s
            s = t.base[s] + c
        assert t.value[s] == i
    assert (t.check >= 0).sum() == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = [f"word{i} thing{i % 7} other" for i in range(50)]
    want = [x.tolist() for x in vocabulary.encode_many(texts)]
    monkeypatch.setattr(P, "REMEMBERED", 5)
    assert [x.tolist() for x in vocabulary.encode_many(texts, together=20)] == want


def test_tables(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(None, "a b"), (3, "a b")], S).selectExpr("*", "1 AS ids")
    out = P.encode(docs)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in P.decode(out.where("doc_id IS NOT NULL AND doc_id <> 3")).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(ODD) if i != 3)
    assert P.encode(docs.limit(0)).count() == 0
    assert np.array([r.n_tokens for r in rows if r.doc_id in (0, 1)]).sum() == 0


def test_long_segments_are_segmented_like_short_ones(vocabulary, monkeypatch):
    import time

    rng = np.random.default_rng(3)
    runs = ["".join(rng.choice(list("abcdeénstu中\U0001f600"), n)) for n in (257, 900, 5000)] + ["the" * 400, "é" * 700, " " * 600, "a" * 1000 + " b"]
    long = [vocabulary.encode(x).tolist() for x in runs]
    monkeypatch.setattr(P, "BLOCK", 64)
    assert [vocabulary.encode(x).tolist() for x in runs] == long
    monkeypatch.setattr(P, "LONG", 1 << 30)
    vocabulary.memory.clear()
    assert [vocabulary.encode(x).tolist() for x in runs] == long
    monkeypatch.undo()
    text = "".join(rng.choice(list("abcdefghij"), 300_000))
    began = time.perf_counter()
    assert vocabulary.decode(vocabulary.encode(text)) == text and time.perf_counter() - began < 10


def test_odd_ids(spark, vocabulary):
    cut = vocabulary.encode("\U0001f9ff")[:2].tolist()
    ids = vocabulary.encode("ok").tolist()
    rows = [(1, cut), (2, [-1, *ids, 10**6]), (3, None), (4, []), (5, [*ids, None])]
    out = {r.doc_id: r.text for r in P.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>")).collect()}
    assert set(out[1]) == {"\ufffd"} and out[2] == "\ufffdok\ufffd" and out[3] == out[4] == "" and out[5] == "ok\ufffd"
