"""Idempotent upserts into a partitioned table of Parquet files, by a manifest that names each partition's files."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Manifest:
    """Versions of a table: which folder holds each partition, and which batches are in it.

    A version is one small file, written beside and renamed into place; the rename fails
    if another writer was faster, so versions follow one another without gaps.  Files of
    versions before stay until ``clean`` deletes what no version from a given one on names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        folder = self.at("_versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if self.fs.exists(folder) else []

    def read(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": -1, "partitions": {}, "batches": [], "schema": None}
        number = known[-1] if version is None else version
        stream = self.fs.open(self.at("_versions", f"{number:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, content: dict) -> None:
        """Makes content the next version, or fails if there is one with its number."""
        beside, place = self.at("_versions", f".{uuid.uuid4().hex}"), self.at("_versions", f"{content['version']:010d}.json")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(beside, place):
            self.fs.delete(beside, False)
            raise RuntimeError(f"version {content['version']} was written by another job")

    def clean(self, first: int | None = None) -> int:
        """Deletes versions before ``first`` (the last one) and folders that none of the others names; how many folders went."""
        known = self.versions()
        keep = [v for v in known if v >= (known[-1] if first is None else first)]
        named = {name for v in keep for name in self.read(v)["partitions"].values()}
        gone = [s.getPath() for s in self.fs.listStatus(self.at("data")) if s.getPath().getName() not in {n.split("/")[0] for n in named}]
        for path in gone:
            self.fs.delete(path, True)
        for v in known:
            if v not in keep:
                self.fs.delete(self.at("_versions", f"{v:010d}.json"), False)
        return len(gone)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows in its last version, or an earlier one."""
    m = Manifest(spark, path)
    known = m.read(version)
    if known["schema"] is None:
        raise ValueError(f"{path} holds no version")
    schema = StructType.fromJson(known["schema"])
    folders = [f"{m.path}/data/{name}" for name in sorted(set(known["partitions"].values()))]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, batch_id: str, keys: list[str], by: str, latest: str) -> bool:
    """Puts a batch's rows into the table at path; rows with a key that is there replace it.  False if the batch was in it already.

    Only partitions (values of ``by``) that the batch touches are written anew, into a folder
    of their own; then one rename makes them the table's, so a job that fails before it
    leaves the table as it was, and a batch that is sent again changes nothing.  Of a batch's
    rows with one key the one with the largest ``latest`` counts.  ``by`` belongs to the keys,
    so a row cannot change its partition.  As many partition values as the batch touches
    come to the driver.
    """
    if by not in keys:
        raise ValueError("the partition column belongs to the keys")
    spark = batch.sparkSession
    m = Manifest(spark, path)
    known = m.read()
    if batch_id in known["batches"]:
        return False
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(latest), *(F.col(c) for c in batch.columns if c not in (*keys, latest)))
    fresh = batch.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    label = F.coalesce(F.col(by).cast("string"), F.lit("__null"))
    touched = sorted(r[0] for r in batch.select(label).distinct().collect())
    folders = sorted({known["partitions"][t] for t in touched if t in known["partitions"]})
    rows = fresh
    if folders:
        old = spark.read.schema(batch.schema).parquet(*[f"{m.path}/data/{name}" for name in folders])
        on = [old[c].eqNullSafe(F.col(f"__new_{c}")) for c in keys]
        rows = old.join(fresh.select(*(F.col(c).alias(f"__new_{c}") for c in keys)), on, "left_anti").select(*batch.columns).unionByName(fresh)
    own = f"{known['version'] + 1:010d}-{uuid.uuid4().hex}"
    if touched:
        # the partition column stays in the files, and folders are named by its hash, so values may be any text
        rows.withColumn("__part", F.md5(label)).write.partitionBy("__part").parquet(f"{m.path}/data/{own}")
    parts = known["partitions"] | {t: f"{own}/__part={hashlib.md5(t.encode()).hexdigest()}" for t in touched}
    m.put({"version": known["version"] + 1, "partitions": parts, "batches": [*known["batches"], batch_id], "schema": json.loads(batch.schema.json())})
    return True
