import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave.llm import chroma

DOCS = "/root/testdata/sf0.001/documents.parquet"
AUDIO = lambda: F.encode("text", "UTF-8")


def prints_of(docs, audio=None, sound=chroma.SHORT):
    rows = chroma.fingerprints(docs, audio if audio is not None else AUDIO(), sound).where("n > 0").toPandas().sort_values("doc_id").drop_duplicates("cid")
    return [(r.doc_id, chroma.ints_of(r.fp)) for r in rows.itertuples()]


def by_comparison(prints):
    """By class id: the earlier ones and offsets that match, from comparing all pairs at all offsets."""
    out = {}
    for k, (name, fp) in enumerate(prints):
        for other, fq in prints[:k]:
            for offset in range(chroma.LEAST_OVERLAP - len(fp), len(fq) - chroma.LEAST_OVERLAP + 1):
                low, high = max(0, -offset), min(len(fp), len(fq) - offset)
                if high - low >= chroma.LEAST_OVERLAP and np.bitwise_count(fp[low:high] ^ fq[low + offset : high + offset]).sum() <= chroma.MOST_ERROR * 32 * (high - low):
                    out.setdefault(name, set()).add((other, offset))
    return out


def by_landmarks(prints):
    """By class id: (match, offset) -> votes of each offset with a vote that passes, by dictionaries."""
    out = {}
    for k, (name, fp) in enumerate(prints):
        mine = dict(zip(*(x.tolist() for x in chroma.landmarks(fp)), strict=True)) if len(fp) >= chroma.LEAST_OVERLAP else {}
        for other, fq in prints[:k]:
            if len(fq) < chroma.LEAST_OVERLAP:
                continue
            for v, p in zip(*(x.tolist() for x in chroma.landmarks(fq)), strict=True):
                if v not in mine:
                    continue
                at, offset = mine[v], p - mine[v]
                low, high = max(0, -offset), min(len(fp), len(fq) - offset)
                near = [(at + d, p + d) for k in range(1, chroma.AROUND + 1) for d in (-k * chroma.STEP, k * chroma.STEP) if 0 <= at + d < len(fp) and 0 <= p + d < len(fq)]
                wrong = sum((int(fp[a] ^ fq[b]) & 0xAAAAAAAA).bit_count() for a, b in near)
                if high - low < chroma.LEAST_OVERLAP or wrong > chroma.AROUND_ERROR * 16 * len(near):
                    continue
                if np.bitwise_count(fp[low:high] ^ fq[low + offset : high + offset]).sum() <= chroma.MOST_ERROR * 32 * (high - low):
                    votes = out.setdefault(name, {})
                    votes[other, offset] = votes.get((other, offset), 0) + 1
    return out


def edited(spark):
    """Texts, some of them cut or moved by a few bytes, with single words changed, or glued to others."""
    rng, rows = np.random.default_rng(4), []
    texts = [r.text for r in spark.read.parquet(DOCS).where("length(text) BETWEEN 900 AND 3000").orderBy("doc_id").limit(14).collect()]
    for t in texts:
        rows.append(t)
        rows += [t[int(rng.integers(1, 200)) :], "x" * int(rng.integers(1, 40)) + t, t + " " + texts[0][:200]]
        words = t.split(" ")
        k = int(rng.integers(len(words) // 2, len(words)))
        rows.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_recall_against_all_pairs_at_all_offsets(spark):
    docs = edited(spark)
    want = by_comparison(prints_of(docs))
    got = {r.class_id: (r.match_id, r.offset, r.bit_error) for r in chroma.align(docs, AUDIO(), chroma.SHORT).where("match_id IS NOT NULL").collect()}
    assert len(want) > 40 and all((m, o) in want[c] for c, (m, o, _) in got.items())  # nothing else than matches
    assert len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [4, 4096])
@pytest.mark.parametrize("partners", [1, 4])
def test_every_class_with_a_voted_match_gets_one(spark, monkeypatch, block, partners):
    monkeypatch.setattr(chroma, "BLOCK", block)  # small ones, so that common values meet in pairs of blocks
    monkeypatch.setattr(chroma, "PARTNERS", partners)
    docs = edited(spark).unionByName(spark.read.parquet(DOCS).selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = by_landmarks(prints_of(docs))
    got = {r.class_id: (r.match_id, r.offset) for r in chroma.align(docs, AUDIO(), chroma.SHORT).where("match_id IS NOT NULL").collect()}
    assert want and got.keys() == want.keys() and all(got[k] in want[k] for k in got)
    if partners > 1:
        assert sum(want[k][got[k]] == max(want[k].values()) for k in got) > 0.9 * len(got)


@pytest.mark.parametrize("partners", [1, 4])
def test_the_number_of_partners_named_at_first_changes_no_result(spark, monkeypatch, partners):
    monkeypatch.setattr(chroma, "PARTNERS", partners)
    docs = edited(spark)
    want = by_landmarks(prints_of(docs))
    first = {k: min((m, -n, o) for (m, o), n in v.items() if m == min(x[0] for x in v)) for k, v in want.items()}
    got = {r.class_id: (r.match_id, -r.votes, r.offset) for r in chroma.align(docs, AUDIO(), chroma.SHORT).where("match_id IS NOT NULL").collect()}
    assert len(want) > 40 and got == first


def joined_by(links, names):
    """By name: the smallest one that links reach."""
    root = {n: n for n in names}
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize(("partners", "block", "part"), [(1, 4, 2), (4, 4096, 32), (2, 8, 8)])
def test_every_voted_link_is_counted_and_joined(spark, monkeypatch, partners, block, part):
    monkeypatch.setattr(chroma, "PARTNERS", partners)
    monkeypatch.setattr(chroma, "BLOCK", block)
    monkeypatch.setattr(chroma, "PART", part)  # small ones, so that components are dealt by pairs of parts
    monkeypatch.setattr(chroma, "PARTS", 3)
    monkeypatch.setattr(chroma, "INTS", 512)
    docs = edited(spark).unionByName(spark.read.parquet(DOCS).selectExpr("doc_id + 1000 AS doc_id", "text"))
    prints = prints_of(docs)
    want = by_landmarks(prints)
    links = {(k, m) for k, v in want.items() for m, _ in v}
    roots = joined_by(links, [name for name, _ in prints])
    got = {r.class_id: r for r in chroma.align(docs, AUDIO(), chroma.SHORT).where("doc_id = class_id AND n_ints > 0").collect()}
    assert len(links) > len(want) and got.keys() == roots.keys()
    assert {k: r.n_links for k, r in got.items()} == {k: sum(k in x for x in links) for k in roots}
    assert {k: r.component_id for k, r in got.items()} == roots


def test_links_to_two_classes_that_do_not_match_are_both_kept(spark):
    texts = [r.text for r in spark.read.parquet(DOCS).where("length(text) > 1600 AND octet_length(text) = length(text)").orderBy("doc_id").limit(2).collect()]
    a, b = (t[:1504] for t in texts)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + "x" * 320 + b)], "doc_id long, text string")
    got = {r.doc_id: (r.match_id, r.component_id, r.n_links) for r in chroma.align(docs, AUDIO(), chroma.SHORT).collect()}
    assert got == {1: (None, 1, 1), 2: (None, 1, 1), 3: (1, 1, 2)}


def rows_made(spark, since, words):
    """Rows that joins whose description has the words made in all executions after the first `since`."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    list_of = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    for run in list(list_of(store.executionsList()))[since:]:
        values = list_of(store.executionMetrics(run.executionId()))
        for node in list_of(store.planGraph(run.executionId()).allNodes()):
            if "Join" in node.name() and words in node.desc():
                total += sum(int(values[m.accumulatorId()].replace(",", "")) for m in list_of(node.metrics()) if m.name() == "number of output rows" and m.accumulatorId() in values)
    return total


def test_a_candidate_is_made_once(spark):
    rng = np.random.default_rng(2)
    ws = chroma.Workspace(spark, "test")
    prints = ws.put(spark.createDataFrame([(k, 40, rng.integers(0, 2**32, 40, dtype=np.uint32).tobytes()) for k in range(30)], "num long, n int, fp binary"), "prints")
    found = spark.createDataFrame([(k, j, 3, None, None, None) for k in range(30) for j in range(k)], chroma.VOTES)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert chroma.first_of(found, prints, 1.0, ws, "first").count() == 29
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert rows_made(spark, since, "n_leader") == 30 * 29 // 2


def bytes_shuffled(spark, since):
    """Bytes that all executions after the first `since` wrote to shuffles."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0.0
    list_of = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    for run in list(list_of(store.executionsList()))[since:]:
        values = list_of(store.executionMetrics(run.executionId()))
        for node in list_of(store.planGraph(run.executionId()).allNodes()):
            for m in list_of(node.metrics()):
                if m.name() == "shuffle bytes written" and m.accumulatorId() in values:
                    number, unit = re.search(r"([\d.,]+) ([KMG]?i?B)", values[m.accumulatorId()]).groups()
                    total += float(number.replace(",", "")) * 1024 ** ["B", "KiB", "MiB", "GiB"].index(unit)
    return total


@pytest.fixture
def long_prints(spark):
    """Prints of 70 classes and their bytes; each is longer than what compression of a shuffle looks back on. Only tables that the code marks are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = np.random.default_rng(6)
    rows = [(k, 20_000, rng.integers(0, 2**32, 20_000, dtype=np.uint32).tobytes()) for k in range(70)]
    yield chroma.Workspace(spark, "test").put(spark.createDataFrame(rows, "num long, n int, fp binary"), "prints"), 70 * 80_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_recording_is_not_sent_for_each_of_its_candidates(spark, long_prints):
    prints, size = long_prints
    ws = chroma.Workspace(spark, "test")
    found = spark.createDataFrame([(k, j, 0, None, None, None) for k in range(70) for j in range(min(k, 9))], chroma.VOTES)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {r.num: sorted(r.leaders) for r in chroma.first_of(found, prints, 1.0, ws, "first").collect()} == {k: list(range(min(k, 9))) for k in range(1, 70)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0.9 * size < bytes_shuffled(spark, since) < 3 * size  # each of 585 candidates alone would be 8 times


def test_a_component_that_one_task_compares_is_sent_once(spark, long_prints):
    prints, size = long_prints
    ws = chroma.Workspace(spark, "test")
    members = ws.put(prints.select("num", F.lit(0).cast("long").alias("root")), "members")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert chroma.links_within(members, prints, 0.125, ws).count() == 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0.9 * size < bytes_shuffled(spark, since) < 1.5 * size


@pytest.mark.parametrize("n", [0, 1, 16, 1000])
def test_packed_integers_come_back(n):
    rng = np.random.default_rng(n)
    alike = np.bitwise_xor.accumulate(np.packbits(rng.random((n, 32)) < 0.13, axis=1).view("<u4").ravel()) if n else np.zeros(0, "<u4")
    for fp in (alike, rng.integers(0, 2**32, n, dtype=np.uint32), np.zeros(n, "<u4"), np.full(n, 2**32 - 1, "<u4")):
        back = chroma.unpacked(chroma.packed(fp))
        assert back.dtype == "<u4" and back.tolist() == fp.tolist()
    assert n < 1000 or len(chroma.packed(alike)) < 0.65 * 4 * n


def test_bits_are_counted_as_32(spark):
    a = np.random.default_rng(1).integers(0, 2**32, 40, dtype=np.uint32)
    b = a ^ np.uint32(1 << 31)  # the highest bit of every integer differs
    rows = [(1, 0, 0, 3, b.tobytes(), a.tobytes())]
    table = spark.createDataFrame(rows, "num long, leader long, offset int, votes long, fp binary, fq binary")
    assert table.mapInArrow(chroma._errors, "num long, leader long, offset int, votes long, bit_error double").first().bit_error == 1 / 32


def test_odd_sounds(spark):
    head = lambda size, fields: b"RIFF\x00\x00\x00\x00WAVEfmt " + struct.pack("<I", size) + fields
    data = b"data" + struct.pack("<I", 4000) + bytes(range(250)) * 16
    odd = {
        "rate 0": head(16, struct.pack("<HHIIHH", 1, 1, 0, 0, 1, 8)) + data, "cut format": head(16, b"\x01\x00\x01"), "short format": head(4, b"\x01\x00\x01\x00") + data, "no format": b"RIFF\x00\x00\x00\x00WAVE" + data,
        "no channel": head(16, struct.pack("<HHIIHH", 1, 0, 8000, 0, 1, 8)) + data, "24 bits": head(16, struct.pack("<HHIIHH", 1, 1, 8000, 0, 1, 24)) + data, "no data": head(16, struct.pack("<HHIIHH", 1, 1, 8000, 0, 1, 8)), "cut head": b"RIFF\x00\x00\x00\x00WAVE",
    }
    good = head(16, struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)) + data
    media = spark.createDataFrame([*odd.items(), ("good", good), ("cut data", good[:-100]), ("raw", b"RIF"), (None, good)], "doc_id string, audio binary")
    out = {r.doc_id: r for r in chroma.align(media, F.col("audio")).collect()}
    assert all(out[k].n_ints == 0 and out[k].class_id == k and out[k].match_id is None for k in odd)
    assert out["good"].n_ints > 0 and out["cut data"].n_ints > 0 and out["raw"].n_ints > 0 and out[None].class_id == "good"
