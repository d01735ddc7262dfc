"""Shared helpers: tables, shared-folder intermediates, checked broadcasts, joins on hot keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of every contract, `[\x20\x09-\x0D]`.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Keys that may be broadcast to filter a larger table, and bytes of any broadcast. Beyond either the join shuffles.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key of more rows than this is hot: its rows aren't dealt to one task.
HOT_ROWS = 1000
#: Rows and bytes in one Arrow batch of texts, so that a batch stays small even where texts are long.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20
#: Hours after which sweep() takes a run's intermediates for left over.
LEFT_OVER_HOURS = 72.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine, where none is named, a folder of our own; elsewhere that would be seen by the driver alone, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hostweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def sweep(spark: SparkSession, hours: float = LEFT_OVER_HOURS) -> int:
    """Deletes intermediates of runs that began more than `hours` ago, and returns how many. Results read them lazily, so a run can't delete its own."""
    fs, p = hadoop(spark, f"{shared_root(spark)}/hostweave")
    old = [s.getPath() for s in fs.listStatus(p) if s.getModificationTime() < (time.time() - hours * 3600) * 1000] if fs.exists(p) else []
    for x in old:
        fs.delete(x, True)
    return len(old)


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/hostweave/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of tables that are written; it does so once the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def row_bytes(df: DataFrame) -> int | None:
    """What a row takes in a broadcast: 16 a number, 96 a string (ids, hashes); None where a column has no such bound."""
    total = 0
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            return None
        total += 96 if isinstance(f.dataType, T.StringType) else 16
    return total


def within(small: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """The table marked for broadcast where neither its rows nor their bytes exceed the bounds."""
    each = row_bytes(small)
    return F.broadcast(small) if each and small.count() <= min(bound, BROADCAST_BYTES // each) else small


def semi(df: DataFrame, keys: DataFrame, on: str, null_safe: bool = False, how: str = "left_semi", bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose key is in keys (one column, distinct), or with left_anti the others: broadcast where the count is within the bound, else shuffled."""
    keys = keys.select(F.col(on).alias("_semi_key"))
    same = F.col(on).eqNullSafe(F.col("_semi_key")) if null_safe else F.col(on) == F.col("_semi_key")
    return df.join(within(keys, bound), same, how)


def keyed(df: DataFrame, table: DataFrame, key: str, rows: str | None = None, how: str = "inner", hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """df joined on key with table, which has a key once; how is inner or left. Rows of a hot key are dealt over several tasks.

    A small table is broadcast. Else the rows of a key that df has more than hot_rows times are dealt by their hash into
    parts of about that size, and the table's row is repeated for each part. `rows` names a column of table with the
    number of df's rows, which is dropped; counts is a table of key and _rows; without either they are counted. Both
    tables are read more than once, so they should be written ones.
    """
    values = table.drop(rows) if rows else table
    marked = within(values)
    if marked is not values:
        return df.join(marked, key, how)
    if counts is None:
        counts = table.select(key, F.col(rows).alias("_rows")) if rows else df.groupBy(key).agg(F.count("*").alias("_rows"))
    hot = counts.where(F.col("_rows") > hot_rows).select(key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    if hot.isEmpty():
        return df.join(values, key, how)
    hot = within(hot)  # at most df's rows / hot_rows
    left = df.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = values.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes; a batch of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unit(*keys: Column) -> Column:
    """A double in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / float(1 << 52)
