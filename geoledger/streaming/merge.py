"""A change stream into a Parquet target in buckets: a micro-batch rewrites the buckets that its keys fall into.

Layout of a target's folder:

    data/version=n/bucket=b/    the rows of bucket b as batch n left them
    versions/n.json             which version holds each bucket's rows after n versions; written last, so it commits a version

A batch that runs again writes the same files again. Versions beyond the last ``retain`` go, and with them the data that no
version left needs.
"""

from __future__ import annotations

import json

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from geoledger.names import unused
from geoledger.plans.merge import OPERATION, plan_merge

#: Buckets of a target; and versions that stay readable.
BUCKETS, RETAIN = 64, 3


def latest_changes(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key in a batch, by ``order``; rows without a whole key all stay."""
    named = [F.col(f"`{k}`") for k in keys]
    whole = F.lit(True)
    for k in named:
        whole = whole & k.isNotNull()
    rows = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
    last = batch.where(whole).groupBy(*named).agg(F.max_by(rows, F.col(f"`{order}`")).alias("r")).select("r.*")
    return last.unionByName(batch.where(~whole))


class Target:
    """A bucketed Parquet target under ``path``, which any file system that Spark writes to may hold."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, retain: int = RETAIN):
        if not keys or buckets < 1 or retain < 1:
            raise ValueError("a target needs keys, buckets and a version to retain")
        self._spark, self._path, self._keys, self._buckets, self._retain = spark, path, keys, buckets, retain

    def _file(self, name: str) -> tuple[JavaObject, JavaObject]:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return at.getFileSystem(self._spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        system, at = self._file(name)
        return system.exists(at)

    def versions(self) -> list[int]:
        """Committed versions that are still there, ascending."""
        system, at = self._file("versions")
        return sorted(int(f.getPath().getName()[:-5]) for f in system.listStatus(at) if f.getPath().getName().endswith(".json")) if system.exists(at) else []

    def _manifest(self, version: int) -> dict[str, int]:
        """Bucket to the version that holds its rows: BUCKETS entries."""
        return self._get(f"versions/{version}.json")

    def _put(self, name: str, text: str) -> None:
        system, at = self._file(name)
        out = system.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> dict:
        return json.loads("".join(r["value"] for r in self._spark.read.text(f"{self._path}/{name}").collect()))  # one small file

    def _commit(self, version: int, held: dict[str, int]) -> None:
        self._put(f"versions/{version}.json", json.dumps(held))

    def bucket(self, columns: list[str]) -> Column:
        """A row's bucket by its keys; rows without a whole key are dealt by all their columns."""
        whole = F.lit(True)
        for k in self._keys:
            whole = whole & F.col(f"`{k}`").isNotNull()
        by = lambda names: F.xxhash64(*(F.col(f"`{c}`") for c in names))
        return F.pmod(F.when(whole, by(self._keys)).otherwise(by(columns)), F.lit(self._buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> None:
        name = unused(rows.columns, "bucket")
        placed = rows.withColumn(name, self.bucket(rows.columns))
        placed.repartition(self._buckets, name).write.partitionBy(name).mode("overwrite").parquet(f"{self._path}/data/version={version}")

    def create(self, rows: DataFrame) -> None:
        """Version 0."""
        self._write(rows, 0)
        self._commit(0, {str(b): 0 for b in range(self._buckets)})
        self._put("schema.json", rows.schema.json())  # for buckets that hold no row

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a version (the last), or of some of its buckets."""
        schema = StructType.fromJson(self._get("schema.json"))
        held = self._manifest(self.versions()[-1] if version is None else version)
        name = unused(schema.names, "bucket")
        folders = [f"{self._path}/data/version={v}/{name}={b}" for b, v in held.items() if buckets is None or b in buckets]
        there = [f for f in folders if self._exists(f.removeprefix(f"{self._path}/"))]
        return self._spark.read.schema(schema).parquet(*there) if there else self._spark.createDataFrame([], schema)

    def merge(self, changes: DataFrame, version: int, operation: str = OPERATION) -> None:
        """Version + 1: the version after changes, of which each whole key has one. Reads and rewrites touched buckets only."""
        columns = [c for c in changes.columns if c != operation]
        touched = [str(r[0]) for r in changes.select(self.bucket(columns)).distinct().collect()]  # BUCKETS numbers at most
        held = self._manifest(version)
        if touched:
            self._write(plan_merge(self.read(version, touched), changes, self._keys, operation), version + 1)
        self._commit(version + 1, held | {b: version + 1 for b in touched})
        self._expire()

    def _expire(self) -> None:
        versions = self.versions()
        kept, old = versions[-self._retain :], versions[: -self._retain]
        needed = {v for k in kept for v in self._manifest(k).values()}
        for version in old:
            system, at = self._file(f"versions/{version}.json")
            system.delete(at, False)
        system, at = self._file("data")
        for folder in system.listStatus(at):
            number = int(folder.getPath().getName().partition("=")[2])
            if number not in needed and number <= kept[-1]:
                system.delete(folder.getPath(), True)


def merge_stream(changes: DataFrame, target: Target, keys: list[str], order: str, operation: str = OPERATION) -> DataStreamWriter:
    """A writer that merges a stream of changes into a target, which must hold version 0: batch n makes version n + 1."""

    def merge(batch: DataFrame, number: int) -> None:
        target.merge(latest_changes(batch, keys, order).drop(order), number, operation)

    return changes.writeStream.foreachBatch(merge)
