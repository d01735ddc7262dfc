import re
from itertools import combinations

import numpy as np
import pytest

from hostweave.llm import parity_join as PJ

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k, t):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())

    sets = {i: shingles(x) for i, x in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * t[1] >= max(len(x), len(y)) * t[0] and t[1] * len(x & y) >= t[0] * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(PJ.jaccard_components(docs, 4, (85, 100))) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, (85, 100))


@pytest.mark.parametrize("t", [(85, 100), (80, 100), (50, 100)])
def test_edited_copies_against_brute_force(spark, t):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 60 if i % 2 else 2000, rng.integers(1, 120))]
        for j in range(5):
            copy = list(words)
            for _ in range(j * len(words) // 60 + (j > 2)):
                copy[rng.integers(len(copy))] = f"x{rng.integers(9999)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    assert got(PJ.jaccard_components(docs, 4, t)) == brute(rows, 4, t)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One Two"), (1, "one\x0btwo"), (2, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (6, "x " * 50_000)]
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA).selectExpr("*", "1 AS cid", "'k' AS keys", "2 AS n_shingles")
    assert got(PJ.jaccard_components(docs, 4, (85, 100))) == brute(rows, 4, (85, 100))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(2, "a b c d e", None, None, None)] * 3 + [(1, "a b c d e", None, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.component_id, r.class_size) for r in PJ.jaccard_components(docs).collect()) == [(1, 1, 4), (2, 1, 4), (2, 1, 4), (2, 1, 4)]
    assert PJ.jaccard_components(docs.limit(0)).count() == 0


def test_keys_of_sets_within_the_threshold_meet():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone, new = int(rng.integers(0, max(1, n // 8) + 1)), int(rng.integers(0, max(1, n // 8) + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
        common, union = n - gone, n + new
        if common * 100 >= 85 * union:
            assert set(PJ.set_keys(np.sort(a), (85, 100))) & set(PJ.set_keys(np.sort(b), (85, 100)))
            assert np.unpackbits((PJ.compact_sketch(a) ^ PJ.compact_sketch(b)).view(np.uint8)).sum() <= gone + new


@pytest.mark.parametrize("leaves", [0, 6, 2048])
def test_leaves_of_a_hub_meet_in_one_task_or_by_members(spark, monkeypatch, leaves):
    """Hubs of few leaves write no row for each member; the way for the rest finds the same."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(int(rng.integers(2, 6))):  # families of copies that link within, and not across
            family = list(base)
            at = int(rng.integers(0, 110))
            family[at : at + 36] = [f"f{x}" for x in rng.integers(0, 10**6, 36)]
            for _ in range(3):
                copy = list(family)
                copy[int(rng.integers(150))] = f"x{rng.integers(10**6)}"
                rows.append((len(rows), " ".join(copy)))
    put, written = PJ.Workspace.put, []
    monkeypatch.setattr(PJ.Workspace, "put", lambda ws, df, name: written.append(name) or put(ws, df, name))
    monkeypatch.setattr(PJ, "GROUP_LEAVES", leaves)
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    assert got(PJ.jaccard_components(docs, 4, (80, 100))) == brute(rows, 4, (80, 100))
    assert "within" in written and ("each" in written) == (leaves < 2048)
    sets = [np.array(x, np.uint64) for x in (range(100), range(5, 105), range(10, 110), range(900, 1000))]
    cids = np.array([4, 5, 6, 7])
    assert PJ.links_within(4, cids, cids, sets, (80, 100)) == [(5, 6)] and PJ.links_within(0, cids, cids, sets, (80, 100)) == [(4, 5), (4, 6)]
    assert PJ.links_within(4, cids, np.array([1, 2, 2, 3]), sets, (80, 100)) == []
