import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hostweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def keep(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if keep(k, m[0])]
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return tuple(sum(s[0] == k for s in spans) for k in PATTERNS) + (digest,)


ODD = [None, "", "plain", "a@b.c_d@e.f x@y", "..@a.b.c. é@x.org ñ me@host.com,you@host.de", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 9.9.9", "4465 7583-8288 9437 4465758382889438 1-2 44657583828894371234", "+1 (771) 555-1655. +123 +1 2 3 4 5 6 7 8 +1((((((2", "\U0001f600 +1 (771) 555-1655 a@b.cc", "a" * 50_000 + "@", "1" * 50_000, "1." * 20_000, "+1" + "-" * 30_000, "x@" + "a." * 20_000]


def test_base_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    want = {r.doc_id: brute(r.text) for r in every.collect()}
    out = pii.find_pii(every.selectExpr("*", "1 AS email", "2 AS spans")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out} == want
    assert any(sum(x[:4]) for x in want.values())
    for r in out:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        kinds = [pii.KINDS.index(k) for k, _, _ in spans]
        assert kinds == sorted(kinds)


def test_wider_forms_are_added_with_support(spark):
    rows = [(i, f"Contact mail: joe{i}@mail.example.com or call +1 (77{i % 10}) 555-1655.") for i in range(40)]
    rows += [(100 + i, f"please email jane{i} [at] example [dot] com today") for i in range(20)] + [(200, "no data here at all")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_email == 1 and out[0].n_phone == 1 and out[200].spans == ""
    assert out[105].n_email == 0 and out[105].n_added == 1 and out[105].n_spans == 1


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expectation_maximisation_weighs_labelers():
    votes = lambda s, g, c, e: {"shape": s, "gazetteer": g, "context": c, "edges": e, "wide": 0, "size": 1}
    m = pii.fit_kind([(votes(1, 1, 1, 1), 50), (votes(1, 1, 0, 1), 40), (votes(2, 2, 2, 2), 60), (votes(2, 2, 0, 1), 30)])
    assert m.reliability["shape", 1][0] > m.reliability["shape", 1][1] and m.reliability["shape", 2][0] < m.reliability["shape", 2][1]
    assert m.weights["shape", 1] > m.weights["shape", 2] and m.prior == pytest.approx(0.5, abs=0.1)


def mixed_corpus(spark):
    """Proposals that only the classifier can tell apart: numbers without a country code and digits that fail or pass the sum, in good and in bad company."""
    rows = [(i, f"call (771) 555-{1000 + i} or pay with card 4465 7583 8288 9437 now") for i in range(30)]
    rows += [(100 + i, f"order id 4465758382889{100 + i} shipped") for i in range(30)]
    rows += [(200 + i, f"build v999.{300 + i}.1.2 of host 10.0.0.{i}") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_classifier_decides_on_proposals(spark, monkeypatch):
    docs = mixed_corpus(spark)

    def added():
        return {r.doc_id: (r.n_judged, r.n_added) for r in pii.find_pii(docs).collect()}

    judged = added()
    assert judged[3] == (1, 1) and all(judged[200 + i] == (1, 0) for i in range(30))
    assert sum(judged[100 + i][0] for i in range(30)) >= 25 and not any(judged[100 + i][1] for i in range(30))
    monkeypatch.setattr(pii.SpanModel, "probability", lambda self, s: F.lit(0.0))
    assert not any(n for _, n in added().values())
    monkeypatch.setattr(pii.SpanModel, "probability", lambda self, s: F.lit(1.0))
    assert all(a == b for a, b in added().values())


def test_many_matches_in_one_text(spark):
    text = " ".join(f"joe{i}@mail.example.com 446575838288{i:04d} (771) 555-{i:04d}" for i in range(3000))
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(text)
    assert r.n_judged > 5000
