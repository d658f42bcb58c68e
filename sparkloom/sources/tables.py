"""Table scans and sinks.  Readers take explicit schemas where the format has none, so no pass infers one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Paths that this process has given out in the shared folder and not deleted.
_WRITTEN: list[str] = []
FORMATS = ("parquet", "orc", "csv", "json", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters are pushed into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Makes tables visible to SQL text under their names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A scan of any built-in file format; csv and json need a schema."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def sink(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Writes df; ``by`` names the partition columns, whose values later scans prune."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def sink_bucketed(df: DataFrame, name: str, path: str, buckets: int, *keys: str) -> None:
    """Saves df below path as a table bucketed and sorted by keys, so that later joins and aggregates on them need no shuffle; a table of that name makes way."""
    df.sparkSession.sql(f"drop table if exists {name}")
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only on one machine, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="sparkloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/sparkloom-tables/{uuid.uuid4().hex}-{name}"
    _WRITTEN.append(path)
    return path


def written() -> list[str]:
    """The paths that scratch() gave out and nothing has deleted."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these paths, or all that scratch() gave out; results that read them can't be read afterwards."""
    for name in written() if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def durable(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: its lineage is cut, and it can't change between two reads."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
