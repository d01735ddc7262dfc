"""Sharding (1): size-tiered compaction of small immutable shards under a versioned manifest."""

from __future__ import annotations

import heapq
import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostweave.llm.common import delete, hadoop

#: Bytes of a shard as it arrives, of a finished file, and runs of a tier that are merged together.
SHARD_BYTES, TARGET_BYTES, FAN_IN = 8 << 20, 128 << 20, 4
#: Sets of runs that one job merges, and hours that replaced versions and files without one are kept.
JOINED, KEPT_HOURS = 64, 24.0 * 7


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class File:
    path: str
    bytes: int


class ShardStore:
    """Parquet files under root/data and manifests under root/manifest; readers see the files of one manifest.

    Files never change. A manifest is written beside and renamed to its version's name, which fails if that name is
    taken; so a version is seen whole or not at all, and of two writers one gets Conflict and tries again on top of the
    other's version. That takes a file system whose rename is atomic and doesn't replace files, as HDFS and local disks
    have; on an object store the commit needs a put that fails where the name is taken. A job that dies before its
    commit leaves only files that no manifest names. vacuum() deletes those and old versions by their age, so neither
    a reader of a recent version nor a writer before its commit loses files.
    """

    def __init__(self, spark: SparkSession, root: str, shard_bytes: int = SHARD_BYTES, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.shard_bytes, self.target_bytes, self.fan_in = shard_bytes, target_bytes, fan_in

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> tuple[int, list[File]]:
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, []
        fs, p = hadoop(self.spark, f"{self.root}/manifest/v{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [File(**x) for x in json.loads(text)["files"]]

    def commit(self, base: int, files: list[File]) -> int:
        fs, part = hadoop(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        _, final = hadoop(self.spark, f"{self.root}/manifest/v{base + 1:08d}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"version": base + 1, "files": [vars(f) for f in files]}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def _listed(self, path: str) -> list[File]:
        fs, p = hadoop(self.spark, path)
        return [File(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")] if fs.exists(p) else []

    def _write(self, df: DataFrame) -> list[File]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self._listed(path)

    def _add(self, new: list[File]) -> int:
        """Commits files on top of whatever version is the last."""
        while True:
            version, files = self.manifest()
            try:
                return self.commit(version, files + new)
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """One arrival: a shard for each of df's partitions, without a shuffle; commits a version."""
        return self._add(self._write(df))

    def append_all(self, df: DataFrame, arrival: Column, arrivals: int) -> Iterator[int]:
        """Arrivals 0 to arrivals - 1, by the column's value, written in one pass over df; yields after committing each one's version."""
        path, name = f"{self.root}/data/{uuid.uuid4().hex}", "_arrival"
        while name in df.columns:
            name = f"_{name}"
        df.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(path)
        for k in range(arrivals):
            yield self._add(self._listed(f"{path}/{name}={k}"))

    def tier(self, f: File) -> int:
        return max(0, math.floor(math.log(max(1, f.bytes) / self.shard_bytes, self.fan_in)) + 1)

    def plan(self, files: list[File]) -> list[list[File]]:
        """Sets of runs to merge, each into one file: of every tier that has fan_in runs or more, those below half the target, packed by size so that the files are alike."""
        tiers: dict[int, list[File]] = {}
        for f in files:
            if f.bytes < self.target_bytes / 2:
                tiers.setdefault(self.tier(f), []).append(f)
        work = []
        for _, runs in sorted(tiers.items()):
            if len(runs) >= self.fan_in:
                # a tier's runs give files of the next tier's size, or of the target
                goal = min(self.target_bytes, max(f.bytes for f in runs) * self.fan_in)
                packs = [(0, k, []) for k in range(max(1, min(math.ceil(sum(f.bytes for f in runs) / goal), len(runs) // 2)))]
                for f in sorted(runs, key=lambda f: (-f.bytes, f.path)):  # the largest first, each to the smallest pack
                    size, k, pack = heapq.heappop(packs)
                    heapq.heappush(packs, (size + f.bytes, k, [*pack, f]))
                work += [pack for _, _, pack in sorted(packs, key=lambda x: x[1]) if pack]
        return work

    def merge(self, work: list[list[File]]) -> list[File]:
        """One file for each set of runs, written by one task, JOINED sets in a job; no shuffle."""
        merged = []
        for at in range(0, len(work), JOINED):
            parts = [self.spark.read.parquet(*[f.path for f in runs]).coalesce(1) for runs in work[at : at + JOINED]]
            merged += self._write(reduce(DataFrame.unionByName, parts))
        return merged

    def compact(self) -> int:
        """Merges until no tier has fan_in runs; each round is a version. Files that a merge leaves alone stay as they are.

        If another writer commits first, the merge goes on top of its version where that still has all merged runs; if
        not, the merged files are deleted and the work is planned again.
        """
        while True:
            version, files = self.manifest()
            work = self.plan(files)
            if not work:
                return version
            merged, gone = self.merge(work), {f.path for runs in work for f in runs}
            while True:
                try:
                    self.commit(version, [f for f in files if f.path not in gone] + merged)
                    break
                except Conflict:
                    version, files = self.manifest()
                    if not gone <= {f.path for f in files}:
                        for f in merged:
                            delete(self.spark, f.path)
                        break

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version, by default the last. A manifest without files needs the schema."""
        _, files = self.manifest(version)
        if not files:
            return self.spark.createDataFrame([], schema or StructType([]))
        return self.spark.read.schema(schema).parquet(*[f.path for f in files]) if schema else self.spark.read.parquet(*[f.path for f in files])

    def vacuum(self, hours: float = KEPT_HOURS) -> None:
        """Deletes manifests but the last that were replaced more than `hours` ago, and files that no manifest left names and that are as old.

        hours must exceed the longest time that a reader uses a version and a writer takes from its first file to its commit.
        """
        versions, limit = self.versions(), (time.time() - hours * 3600) * 1000
        written = {}
        for v in versions:
            fs, p = hadoop(self.spark, f"{self.root}/manifest/v{v:08d}.json")
            written[v] = fs.getFileStatus(p).getModificationTime()
        old = [v for v, after in zip(versions, versions[1:], strict=False) if written[after] < limit]
        named = {f.path for v in versions if v not in old for f in self.manifest(v)[1]}
        for v in old:
            delete(self.spark, f"{self.root}/manifest/v{v:08d}.json")
        fs, p = hadoop(self.spark, f"{self.root}/data")
        found = fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            if s.getModificationTime() < limit and s.getPath().getName().endswith(".parquet") and s.getPath().toString() not in named:
                fs.delete(s.getPath(), False)


def shard(docs: DataFrame, root: str, arrivals: int = 4, shard_bytes: int = SHARD_BYTES, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Appends docs in `arrivals` batches, compacting after each, and returns the rows as the last manifest has them.

    All columns and rows are kept as they are, nulls and repeated rows too; a column shard with the file's name is added
    (as _shard where that name is taken). A batch is a hash of doc_id; null ids go to one batch. docs is read once. An
    empty table is a manifest of no shards.
    """
    store = ShardStore(docs.sparkSession, root, shard_bytes, target_bytes, fan_in)
    for _ in store.append_all(docs, F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(arrivals)), arrivals):
        store.compact()
    name = "shard" if "shard" not in docs.columns else "_shard"
    rows = store.read(schema=docs.schema)
    return rows.withColumn(name, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1) if store.manifest()[1] else F.lit(None).cast("string"))


#: DuckDB twin of the query: every row once, with its whole text, from a file that the manifest names.
ORACLE = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256, true AS listed FROM documents"
