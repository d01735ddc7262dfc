import re
from collections import Counter

import corpus_pipeline as C
from test_parity_join import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, rows = docs.columns, docs
    for (name, stage), op in zip(C.STAGES, (6, 8, 2, 9, 3), strict=True):
        before = [r.asDict() for r in rows.collect()]
        rows = stage(spark, rows, "/root/testdata/sf0.001").persist()
        after = [r.asDict() for r in rows.collect()]
        assert op == 3 or rows.columns == columns, name
        ids = Counter(r["doc_id"] for r in after)
        if op == 6:
            assert set(ids) == {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"] or "")}
        if op == 8:
            best = {}
            for r in before:
                k = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
                best[k] = min(best.get(k, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
            assert ids == Counter(x[1] for x in best.values())
        if op == 2:
            found = brute([(r["doc_id"], r["text"]) for r in before], 5, (80, 100))
            assert ids == Counter(i for i, (_, c) in found.items() if i == c)
        if op == 9:
            assert max(ids.values()) <= 2 and set(ids) <= {r["doc_id"] for r in before}
            words = sum(len((r["text"] or "").split()) for r in before)
            assert abs(sum(len((r["text"] or "").split()) for r in after) - 1.5 * words) < 0.1 * words
        if op == 3:
            assert len(after) == len(before) and all(r["round_trip"] for r in after)


def test_repeated_and_odd_rows(spark):
    S = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the of and ing {i} word", "en", "s", 1) for i in range(30)] + [(5, "the of and ing 5 word", "en", "s", 1), (5, "another text", None, None, None), (None, "the only one", None, None, None), (99, None, None, None, None)]
    docs = spark.createDataFrame(rows, S)
    kept = C.exact(spark, docs, "")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.dropDuplicates(["doc_id", "text"]).collect()))
    assert C.near(spark, kept, "").count() == 33 and C.mix(spark, kept, "").columns == docs.columns
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_clashing_names(spark):
    rows = [(i % 25, f"the of and ing {i % 20} word and some more of it", "en", "s", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["row", "found", "id", "sha", "hash", "place", "size", "copies", "kept", "keep_id", "n", "k", "key", "cid", "_k", "_c", "_part", "_lid", "tag", "component_id", "n_words", "a.b"]
    more = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, more, "")
        assert out.columns == more.columns, name
        plain = stage(spark, docs, "")
        assert Counter(map(str, out.select(*docs.columns).collect())) == Counter(map(str, plain.collect())), name
    assert C.encode(spark, more, "").count() == 30
