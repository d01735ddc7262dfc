"""Secret scans (7, native): a random forest removes false positives among candidate tokens."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm.common import Workspace, unit
from hostweave.llm.located import add_matches, apart

_RUN, _END = r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])"
#: Runs of 16 token characters or more with a digit, and issued formats; look-behind and look-ahead are tested once for each run.
TOKEN = rf"{_RUN}(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}|(?:A[KS]IA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}+){_END}|xox[abpr]-[A-Za-z0-9+/_-]*+)"
WORDS = r"(?:token|secret|passwo?r?d|passwd|pwd|api_?key|key|auth|bearer|credential)s?"
#: A value of any length that a keyword assigns.
ASSIGNED = rf"(?i){WORDS}[\"']?[ \t]*+(?:=>|:=|==|[=:])[ \t]*+[\"']?([^\s\"',;]++)"
#: Findings that the forest is trained on at most, findings that are made where none are given, and words in the dictionary.
SAMPLE, MADE, DICTIONARY = 20_000, 6000, 4000
FEATURES = ["length", "transitions", "letter_share", "digit_share", "upper_share", "distinct_share", "hex_only", "coverage", "path_hint", "assigned", "keyword", "harmless", "quoted", "glued", "issued"]
# Words that stand before secrets and before values that look like them, and parts of paths of code that has made-up ones.
KEYWORD = rf"(?i){WORDS}\W{{0,4}}$"
HARMLESS = r"(?i)(?:commit|sha(?:1|256)?|md5|checksum|digest|hash|uuid|id|order|invoice|card|serial|build|version|revision|file|path|url)\W{0,4}$"
PATHS = r"(?i)test|example|sample|mock|doc|fixture"
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9]{20,}$|^xox[abpr]-"
#: Of made findings: values (SQL over the hashes h and g and the words w1 and w2), those that are secrets first, and what stands before them.
SECRET_VALUES = ["left(h, 40)", "left(h, 32)", "translate(left(b, 32), '+/=', 'Kq7')", "concat('AKIA', upper(translate(left(b, 16), '+/=', 'XQ7')))", "concat('ghp_', translate(left(concat(b, b), 36), '+/=', 'Zk3'))", "concat(translate(left(b, 9), '+/=', 'h4z'), '!', left(g, 2))", "concat('sk-', translate(left(b, 28), '+/=', 'd8R'))"]
SECRET_LEADS = ["token = ", "password: ", "api_key=", "secret := ", "Authorization: Bearer ", "AUTH_TOKEN = ", "credentials = ", "key => "]
OTHER_VALUES = ["left(h, 40)", "left(h, 32)", "translate(left(h, 16), 'abcdef', '038271')", "concat(w1, '_', w2, '_', left(translate(h, 'abcdef', '038271'), 2), '_', w1)", "concat('your_', w1, '_here')", "concat(w1, w2)", "repeat(left(h, 1), 20)", "concat('src/', w1, '/', w2, '/v', left(translate(h, 'abcdef', '038271'), 1))", "concat(left(h, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))", "'changeme'", "concat('${', upper(w1), '_', upper(w2), '}')"]
OTHER_LEADS = {"left(h, 40)": ["commit ", "sha1: "], "left(h, 32)": ["md5: ", "checksum "], "concat('your_', w1, '_here')": ["api_key = ", "token: "], "concat(w1, w2)": ["password = ", "secret: ", "see "], "'changeme'": ["password: ", "PASSWORD="], "concat('${', upper(w1), '_', upper(w2), '}')": ["password: ", "token="], "repeat(left(h, 1), 20)": ["token = ", "fill "]}
OTHER_PLAIN = ["", "order ", "id: ", "uuid ", "card ", "see "]


def dictionary(texts: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more of a reference table; ties by code point."""
    each = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    top = each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()
    return sorted(r["w"] for r in top)


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """One row per candidate: doc_id, start, end, token_sha256, FEATURES."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rows = add_matches(rows, "text", {"token": (r"[A-Za-z0-9+/_-]{16}|xox[abpr]-", TOKEN), "assigned": (rf"(?i){WORDS}[\"']?[ \t]*+[=:]", ASSIGNED)})

    def value_of(m: Column) -> Column:
        value = F.regexp_extract(m["text"], ASSIGNED, 1)
        start = m["end"] - F.length(value)
        prefix = F.substr(m["text"], F.lit(1), F.length(m["text"]) - F.length(value))
        return F.struct(start.alias("start"), m["end"].alias("end"), value.alias("text"), prefix.alias("before"), m["after"].alias("after"), F.lit(True).alias("by_keyword"))

    tokens = F.transform("m_token", lambda m: F.struct(*[m[k].alias(k) for k in ("start", "end", "text", "before", "after")], F.lit(False).alias("by_keyword")))
    rows = rows.withColumns({"_tokens": tokens, "_values": F.transform("m_assigned", value_of)}).drop("m_token", "m_assigned")
    rows = apart(rows, "_values", "_tokens", lambda t: F.lit(True), lambda a: F.lit(False))
    rows = rows.select("doc_id", "path", F.explode(F.concat("_tokens", "_values")).alias("m"))
    token, n = F.col("m.text"), F.length("m.text")
    share = lambda p: F.length(F.regexp_replace(token, p, "")) / n
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "\u0001"), "[A-Z]", "\u0002"), "[0-9]", "\u0003"), "\u0001\u0002\u0003", "aA0")
    changes = F.length(F.regexp_replace(classes, r"(.)\1*+", "x")) - 1
    runs = F.regexp_extract_all(F.lower(token), F.lit("[a-z]{3,}"), F.lit(0))
    known_words = F.filter(runs, lambda w: w.isin(words) if words else F.lit(False))
    covered = F.aggregate(known_words, F.lit(0), lambda a, w: a + F.length(w))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values: dict[str, Column] = {
        "length": n.cast("double"), "transitions": changes / n, "letter_share": share("[^A-Za-z]"), "digit_share": share("[^0-9]"), "upper_share": share("[^A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(token, ""))) / n, "hex_only": flag(token.rlike("^[0-9a-f]+$")), "coverage": covered / n, "path_hint": flag(F.col("path").rlike(PATHS)),
        "assigned": flag(F.col("m.by_keyword") | F.col("m.before").rlike(r"[=:]\s*[\"']?$")), "keyword": flag(F.col("m.by_keyword") | F.col("m.before").rlike(KEYWORD)), "harmless": flag(F.col("m.before").rlike(HARMLESS)), "quoted": flag(F.col("m.before").rlike("[\"']$")), "issued": flag(token.rlike(ISSUED)), "glued": flag(F.col("m.after").rlike(r"^[\p{L}0-9]")),
    }
    return rows.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.sha2(token, 256).alias("token_sha256"), *[v.cast("double").alias(k) for k, v in values.items()])


def made_findings(spark: SparkSession, words: list[str], n: int = MADE, since: int = 0) -> DataFrame:
    """doc_id, text, source, label: texts with one candidate each, half of them secrets, for training where no reviewed findings are given.

    The label is what was put there, not a rule over what the forest sees: random values as services issue them behind
    words that assign them, and their lookalikes: digests, numbers, identifiers, paths, placeholders. A tenth stands
    the other way round, as in life: a bare secret in prose, a made-up one in a test. Every value is a hash of its number.
    """
    vocabulary = [F.lit(w) for w in ([x for x in words if len(x) < 12][:400] or ["value", "config", "number", "other"])]
    hashed = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id").cast("string")), 256)
    pick = lambda options, k: F.element_at(F.array(*options), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(options))) + 1).cast("int"))
    rows = spark.range(since, since + n).withColumns({"h": hashed("h"), "g": hashed("g"), "b": F.base64(F.unhex(hashed("b"))), "w1": pick(vocabulary, 1), "w2": pick(vocabulary, 2), "odd": F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(10)) == 0})
    secret = F.col("id") % 2 == 0
    quote = pick([F.lit(x) for x in ("", '"', "'")], 3)
    good = F.concat(F.when(F.col("odd"), F.lit("found ")).otherwise(pick([F.lit(x) for x in SECRET_LEADS], 4)), quote, pick([F.expr(x) for x in SECRET_VALUES], 5), quote)
    kinds = [F.concat(pick([F.lit(x) for x in OTHER_LEADS.get(v, OTHER_PLAIN)], 6), quote, F.expr(v), quote) for v in OTHER_VALUES]
    # what a test has for a secret, behind the same words
    fake = F.concat(pick([F.lit(x) for x in SECRET_LEADS], 4), quote, pick([F.expr(x) for x in SECRET_VALUES], 5), quote)
    text = F.concat("w1", F.lit(" "), "w2", F.lit(" "), F.when(secret, good).when(F.col("odd"), fake).otherwise(pick(kinds, 7)), F.lit(" "), "w2")
    source = F.when(~secret & F.col("odd"), pick([F.lit(x) for x in ("tests/fixtures", "docs/examples")], 8)).otherwise(pick([F.lit(x) for x in ("src/app", "crawl", "deploy/prod")], 8))
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), secret.cast("double").alias("label"))


def fit(findings: DataFrame, sample: int = SAMPLE, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest on labelled findings: label (0 or 1; null ones aren't used) and FEATURES, an expected `sample` of them by a hash of their values. None where one class is missing.

    The bounded sample is sorted into one partition, so a forest depends on the findings alone and not on how they lie in files.
    """
    findings = findings.select(F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES]).where("label IN (0, 1)").fillna(0.0)
    n = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, sample / 2 / n[1.0])).otherwise(min(1.0, sample / 2 / n[0.0]))
    drawn = findings.where(unit(F.lit(seed), "label", *FEATURES) < rate)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn.coalesce(1).sortWithinPartitions("label", *FEATURES)).select("features", "label")
    return RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, reference: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate token: doc_id, start, end, token_sha256, probability, secret.

    Candidates are runs of 16 or more token characters with a digit, issued formats, and values of any length that a keyword
    assigns, apart from those; in whole texts. Places are code points, end exclusive.
    The forest sees length, character classes and their changes, the share of letters in dictionary words (from the
    reference table), the path (source), the words before and whether a format is an issued one, and decides alone:
    a candidate is a secret from `threshold` on. findings: label and FEATURES of reviewed candidates (see candidates());
    without them made_findings() train it. Findings of one class alone teach nothing, so all candidates are then of
    that class, or secrets where there are no findings. Null texts, sources and doc_ids are allowed; rows that repeat give repeated rows; without
    candidates the result is empty. Secrets themselves aren't returned.
    """
    ws, words = Workspace(docs.sparkSession, "secrets"), dictionary(reference)
    found = ws.put(candidates(docs, words), "candidates")
    if findings is None:
        made = made_findings(docs.sparkSession, words)
        findings = candidates(made, words).join(made.select("doc_id", "label"), "doc_id")
    findings = ws.put(findings, "findings")
    model = fit(findings)
    if model is None:
        only = findings.where("label IN (0, 1)").agg(F.max("label")).first()[0]
        scored = found.withColumn("probability", F.lit(1.0 if only is None else float(only)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "token_sha256", "probability", (F.col("probability") >= threshold).alias("secret"))
