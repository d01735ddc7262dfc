"""Tables written to the folder that driver and executors share, which cut the lineage of long plans; and small files on any file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On one machine, where none is named, a folder of our own; elsewhere that would be seen by the driver alone, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hostweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: plans built on it begin at its scan, and a lost executor loses none of it.

    Frames that are kept in memory and built on each other carry all plans below them, which makes planning slow.
    """
    path = f"{shared_folder(df.sparkSession)}/hostweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside and then renamed over what is there."""
    fs, part = _file(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, final = _file(spark, path)
    if not fs.rename(part, final):  # some file systems don't rename over a file
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
