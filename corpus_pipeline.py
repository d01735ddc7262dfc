"""A corpus pipeline of five stages over `documents`; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostweave.llm import exact_dedup, langid, mixing, parity_join, pieces
from hostweave.llm.common import Workspace, semi, small_batches, within

#: Documents of a language below this confidence go, as do those without a letter.
LEAST_SCORE = 0.5


def _whole(docs: DataFrame) -> Column:
    """A row in one column, so that no name of ours clashes with the table's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is predicted with some confidence.

    Null, empty and letterless texts have no language and go; where nothing can be learned (no lang at all, an empty table)
    all go. Repeated rows share one decision.
    """
    model = langid.fit(docs)
    small_batches(spark)
    found = docs.select(_whole(docs), langid.predict_column(model).alias("found"))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, also where rows repeat a doc_id. Null and empty texts are one group; an empty table stays empty."""
    ws = Workspace(spark, "pipeline-exact")
    groups = ws.put(exact_dedup.exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "groups")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    ids = ws.put(ids.where("k < n OR n > 1"), "ids")
    rest = semi(docs, ids, "doc_id", null_safe=True, how="left_anti")
    repeated = ids.where("n > 1 AND k > 0")
    if repeated.isEmpty():
        return rest
    stays = groups.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    again = semi(docs, repeated, "doc_id", null_safe=True)
    again = again.select(_whole(again), F.col("doc_id").alias("of"), F.sha2(exact_dedup.normalise("text"), 256).alias("hash"), F.length("text").alias("n_chars"), F.xxhash64("text").alias("tie"))
    again = again.join(stays, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("sha")))
    longest = Window.partitionBy("id", "sha").orderBy(F.col("n_chars").desc_nulls_last(), "tie")
    return rest.unionByName(again.withColumn("place", F.row_number().over(longest)).where("place = 1").select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near duplicates (5 words, 0.8). Documents without words stay, and so do all rows of a doc_id of which one stays. An empty table stays empty."""
    ws = Workspace(spark, "pipeline-near")
    found = parity_join.jaccard_components(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return semi(docs, ws.put(found.where("NOT stays"), "goes"), "doc_id", null_safe=True, how="left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it.

    Texts without words weigh nothing and go. A null source is a source, and a null doc_id an id; rows that repeat a
    doc_id, source and number of words are repeated alike. An empty table stays empty.
    """
    ws = Workspace(spark, "pipeline-mix")
    mixed = mixing.mix_sources(docs).where(F.col("copies") > 0)
    copies = ws.put(mixed.select(F.col("doc_id").alias("id"), "source", "size", F.col("copies").cast("int").alias("copies")).distinct(), "copies")
    rows = docs.select(_whole(docs), mixing.words("text").alias("n_words"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("n_words") == F.col("size"))
    return rows.join(within(copies), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, repeats included: doc_id, ids, n_tokens, round_trip. A null or empty text has no ids; an empty table gives an empty result."""
    return pieces.encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written and read again before the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return docs


#: The trained language model, the rounding and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
