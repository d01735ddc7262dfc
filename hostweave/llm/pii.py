"""PII (5, native): labelers vote, expectation-maximisation weighs them and trains a span classifier."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm.common import Workspace
from hostweave.llm.located import add_matches, apart

KINDS = ("email", "ip", "card", "phone")

# Possessive repeats and look-behinds give the same leftmost matches as the plain patterns, without backtracking over
# long runs: what follows a possessive repeat is never in its class, and where a run's first place fails its later ones do.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Wider forms that the labelers decide on: spelt-out addresses, eight groups of hex, 15-digit cards, numbers without a country code.
WIDE = {
    "email": (r"(?i)[\[(]at[\])]", r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]++)++"),
    "ip": (r"[0-9a-fA-F]:[0-9a-fA-F]", r"(?<![0-9a-fA-F:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}(?![0-9a-fA-F:])"),
    "card": (r"3[47]", r"(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])"),
    "phone": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
}
# Gazetteers and context words of the labelers.
GAZETTEER = {
    "email": r"(?i)[.\])\x20](?:com|org|net|edu|gov|info|io|example|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-1][0-9]|22[0-3])\.|^(?i)(?:2[0-9a-f]{3}|f[cde][0-9a-f]{2}):",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
CONTEXT_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\W{0,3}$",
    "ip": r"(?i)\b(?:ip|host|server|address|from)\W{0,3}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment|cc)\W{0,3}$",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|contact)\W{0,3}$",
}
CONTEXT_AGAINST = r"(?i)\b(?:version|ver|v|id|isbn|order|ref|invoice|serial|hash|build|release)\W{0,3}$"
#: Wider spans are added from this probability on.
ACCEPT = 0.9
#: Failed base matches that are proposed again: digits of a card or phone number, and addresses with too large a part.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: What the digit sum and the shape checks are taken to have judged before the corpus is seen: (right, wrong) votes.
TRUST = {"shape": (30.0, 0.3)}
#: Penalty of the span classifier, in candidates.
RIDGE = 0.02
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def passes(kind: str, text: Column) -> Column:
    """The check of a base match."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & luhn(text)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def votes(kind: str, m: Column, strict: Column, wide: bool) -> dict[str, Column]:
    """Each labeler's vote on a match: 1 for, 2 against, 0 none. The shape of a card is its digit sum, that of a wider form without a check says nothing."""
    if kind == "card":
        shape = F.when(luhn(m["text"]), 1).otherwise(2)
    else:
        shape = F.lit(0) if wide else F.when(strict, 1).otherwise(2)
    return {
        "shape": shape,
        "gazetteer": F.when(m["text"].rlike(GAZETTEER[kind]), 1).otherwise(2),
        "context": F.when(m["before"].rlike(CONTEXT_FOR[kind]), 1).when(m["before"].rlike(CONTEXT_AGAINST), 2).otherwise(0),
        "edges": F.when(m["before"].rlike(r"[\p{L}0-9_=/]$") | m["after"].rlike(r"^[\p{L}0-9_=/]"), 2).otherwise(1),
    }


LABELERS = ("shape", "gazetteer", "context", "edges")
#: The classifier's features besides the votes: length of the match in four classes, and whether it is a wider form.
SPAN = "struct<start:int,end:int,strict:boolean,wide:boolean,shape:int,gazetteer:int,context:int,edges:int,size:int>"
def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, by kind, an array of SPAN for each row of docs: base spans, and proposals apart from those.

    Proposals are the wider forms, and base matches that fail their check but have the digits of a number of that kind.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = add_matches(rows, "text", {f"{k}_base": p for k, p in BASE.items()} | {f"{k}_wide": p for k, p in WIDE.items()})

    def spans(kind: str, wide: bool) -> Column:
        def one(m: Column) -> Column:
            strict = F.lit(False) if wide else passes(kind, m["text"])
            v = {k: x.cast("int") for k, x in votes(kind, m, strict, wide).items()}
            size = F.least(F.floor(F.length(m["text"]) / 8), F.lit(3)).cast("int")
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), strict.alias("strict"), F.lit(wide).alias("wide"), *[v[x].alias(x) for x in LABELERS], size.alias("size"))

        matches = F.col(f"m_{kind}_{'wide' if wide else 'base'}")
        if not wide and kind in DIGITS:  # drop what neither passes nor is proposed: years, sums, single groups
            low, high = DIGITS[kind]
            matches = F.filter(matches, lambda m: F.length(F.regexp_replace(m["text"], "[^0-9]", "")).between(low, high) | passes(kind, m["text"]))
        return F.transform(matches, one)

    rows = rows.select("doc_id", *[spans(k, False).alias(f"b_{k}") for k in KINDS], *[spans(k, True).alias(f"w_{k}") for k in KINDS])
    for k in KINDS:
        rows = apart(rows, f"w_{k}", f"b_{k}", lambda b: b["strict"], lambda w: F.lit(False))
        rows = apart(rows, f"b_{k}", f"w_{k}", lambda w: F.lit(True), lambda b: b["strict"])
    return rows.select("doc_id", *[F.array_sort(F.concat(f"b_{k}", f"w_{k}").cast(f"array<{SPAN}>")).alias(k) for k in KINDS])  # structs compare by start first


@dataclass
class SpanModel:
    """Per kind: the labelers' odds from expectation-maximisation, and the weights of the classifier trained on them."""

    prior: float
    reliability: dict[tuple[str, int], tuple[float, float]]
    weights: dict[tuple[str, int], float]
    bias: float

    def probability(self, s: Column) -> Column:
        z = F.lit(float(self.bias))
        for (name, value), w in sorted(self.weights.items()):
            z = z + F.when(s[name].cast("int") == value, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit_kind(patterns: list[tuple[dict[str, int], int]], rounds: int = 40, steps: int = 40) -> SpanModel:
    """patterns: (votes and features, number of candidates), a bounded table whatever the corpus.

    A two-class naive Bayes over the labelers' votes, started from their weighted majority, gives each pattern a probability; a
    logistic regression over votes and features is then trained on those by ridged Newton steps.
    """
    total = sum(n for _, n in patterns) or 1
    weigh = {x: math.log(right / wrong) for x, (right, wrong) in ({k: (2.0, 1.0) for k in LABELERS} | TRUST).items()}
    guess = [0.9 if sum(weigh[x] * ((v[x] == 1) - (v[x] == 2)) for x in LABELERS) > 0 else 0.1 for v, _ in patterns]
    prior, reliability = 0.5, {}

    def odds(v: dict[str, int], share: float) -> float:
        z = math.log(share / (1 - share)) + sum(math.log(reliability[x, v[x]][0] / reliability[x, v[x]][1]) for x in LABELERS)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    for _ in range(rounds):
        mass = sum(n * g for (_, n), g in zip(patterns, guess, strict=True))
        prior = (mass + 1) / (total + 2)
        for x in LABELERS:
            # the smoothing says that a vote is rather right than wrong, and of some labelers that it nearly always is
            right, wrong = TRUST.get(x, (2.0, 1.0))
            for value, before in ((0, (wrong, wrong)), (1, (right, wrong)), (2, (wrong, right))):
                yes = sum(n * g for (v, n), g in zip(patterns, guess, strict=True) if v[x] == value)
                no = sum(n * (1 - g) for (v, n), g in zip(patterns, guess, strict=True) if v[x] == value)
                reliability[x, value] = ((yes + before[0]) / (mass + right + 2 * wrong), (no + before[1]) / (total - mass + right + 2 * wrong))
        guess = [odds(v, prior) for v, _ in patterns]
    # nearly all candidates are base spans, which nobody judges; their share says nothing about a proposal
    guess = [odds(v, 0.5) for v, _ in patterns]
    names = sorted({(x, v[x]) for v, _ in patterns for x in v})
    x = np.array([[1.0] + [float(v[name] == value) for name, value in names] for v, _ in patterns]).reshape(len(patterns), len(names) + 1)
    count, target, w = np.array([n for _, n in patterns], dtype=float), np.array(guess), np.zeros(len(names) + 1)
    for _ in range(steps if patterns else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (p - target)) + RIDGE * w
        bend = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    return SpanModel(prior, reliability, dict(zip(names, w[1:].tolist(), strict=True)), float(w[0]))


def fit(found: DataFrame) -> dict[str, SpanModel]:
    """Counts of vote patterns over all candidates of the corpus; at most 2 * 3**4 * 4 a kind reach the driver."""
    features = [*LABELERS, "wide", "size"]

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[x].cast("int").alias(x) for x in features]))

    each = F.explode(F.concat(*[of(k) for k in KINDS]))
    counted = found.select(each.alias("c")).groupBy("c.kind", *[F.col(f"c.{x}").alias(x) for x in features]).count().collect()
    table = sorted(((r["kind"], {x: r[x] for x in features}, r["count"]) for r in counted), key=str)
    return {k: fit_kind([(v, n) for kind, v, n in table if kind == k]) for k in KINDS}


def find_pii(docs: DataFrame, models: dict[str, SpanModel] | None = None, accept: float = ACCEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_judged, n_added, n_spans.

    Base spans are the leftmost non-overlapping matches of each kind that pass its check; the counts and base_sha256 are
    theirs. Proposals are wider forms apart from base spans, and base matches that fail their check but have the digits
    of a number of that kind; n_judged counts them. The trained classifier judges each by itself: spans also has those
    whose probability reaches `accept`, counted by n_added; n_spans counts all. A span is kind:start:end in code points,
    end exclusive, in the order of KINDS and then start. A null text is empty; without spans the strings are empty (and
    base_sha256 that of an empty string). Repeated rows get equal results, an empty table an empty result.
    """
    ws = Workspace(docs.sparkSession, "pii")
    found = ws.put(candidates(docs), "candidates")
    models = models or fit(found)

    def written(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = {k: F.filter(k, lambda s: s["strict"]) for k in KINDS}
    every = {k: F.filter(k, lambda s: s["strict"] | (models[k].probability(s) >= accept)) for k in KINDS}
    total = lambda arrays: sum((F.size(a) for a in arrays[1:]), F.size(arrays[0])).cast("long")
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", F.concat(*[written(k, base[k]) for k in KINDS])), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*[written(k, every[k]) for k in KINDS])).alias("spans"),
        (total([F.col(k) for k in KINDS]) - total([base[k] for k in KINDS])).alias("n_judged"),
        (total([every[k] for k in KINDS]) - total([base[k] for k in KINDS])).alias("n_added"),
        total([every[k] for k in KINDS]).alias("n_spans"),
    )
