"""The queries opN_<name> of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import chroma, compaction, exact_dedup, langid, mixing, parity_join, pieces, pii, secrets, toxicity
from hostweave.llm.common import Workspace, table, within


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards documents and reads them back: doc_id, n_chars, text_sha256, listed (the file that the row was read from is in the last manifest on disk, and no larger than twice the target)."""
    docs = table(spark, sf_dir, "documents")
    root = f"{Workspace(spark, 'sharding').root}/store"
    rows = compaction.shard(docs, root)
    files = [(f.path.split("/")[-1],) for f in compaction.ShardStore(spark, root).manifest()[1] if f.bytes <= 2 * compaction.TARGET_BYTES]
    manifest = spark.createDataFrame(files, "_file string").withColumn("_in", F.lit(True))
    rows = rows.join(within(manifest), F.col("shard") == F.col("_file"), "left")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.coalesce("_in", F.lit(False)).alias("listed"))


def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"), shingle=4, threshold=(85, 100))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has recordings, so the UTF-8 bytes of each whole text are taken as unsigned 8-bit samples."""
    return chroma.align(table(spark, sf_dir, "documents"), F.encode("text", "UTF-8"), chroma.SHORT)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_parity_join, op3_sentencepiece, op4_chroma, op5_pii, op6_language_id, op7_secrets, op8_exact_dedup, op9_pivotal_mixing, op10_toxicity)
}
ORACLES: dict[str, str] = {"op1_sharding": compaction.ORACLE, "op2_parity_join": parity_join.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
