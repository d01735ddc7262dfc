from collections import Counter

import numpy as np

from hostweave.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def water(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(w[s] for s in left))
        over = [s for s in left if w[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | {s: w[s] * level for s in left}
        capped |= {s: 2.0 * sizes[s] for s in over}


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.pareto(1.2) * 20 + 1)), rng.choice(["b", "a", "Z", "é", "c"], p=[0.5, 0.2, 0.1, 0.1, 0.1])) for i in range(n)]


def test_targets_and_taken(spark):
    rows = rows_of(3000) + [(9001, None, "a"), (9002, " \n", None), (9003, "x y", None), (None, "x y z", "a")]
    docs = spark.createDataFrame([(i, x, None if s is None else str(s), None) for i, x, s in rows], SCHEMA)
    out = M.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, x, s in rows:
        sizes[None if s is None else str(s)] += len((x or "").split())
    want = water(dict(sizes))
    taken, most = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1


def test_reruns_and_partitionings_agree(spark):
    docs = spark.createDataFrame([(i, x, str(s), None) for i, x, s in rows_of(500)], SCHEMA)
    one = sorted((r.doc_id, r.taken) for r in M.mix_sources(docs).collect())
    assert one == sorted((r.doc_id, r.taken) for r in M.mix_sources(docs.repartition(7)).collect())


def test_rounding_keeps_expectation(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 3), "a" if i < 400 else "b", None) for i in range(440)], SCHEMA)
    copies = Counter()
    for seed in range(12):
        copies.update({r.doc_id: r.copies for r in M.mix_sources(docs, weights=(1, 1), seed=seed).collect() if r.source == "a"})
    rate = 1.5 - (2 * 40 - 1.5 * 40) / 400
    for size in range(3):
        mean = np.mean([copies[i] / 12 for i in range(400) if i % 3 == size])
        assert abs(mean - rate) < 0.06


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", None)] * 4 + [(2, "d", "s", None)], SCHEMA)
    assert len({r.copies for r in M.mix_sources(docs).collect() if r.doc_id == 1}) == 1
    assert M.mix_sources(docs.limit(0)).count() == 0
    assert [r.taken for r in M.mix_sources(docs.selectExpr("doc_id", "cast(null AS string) AS text", "source")).collect()] == [0] * 5
