"""What the operators share: input columns, the shared folder, and shipping the package."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Paths below the shared folder that this process has given out and not deleted.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (tests), where none is named, a temporary folder is made,
    and used for checkpoints too; on a cluster executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; everything the operators write is under sparkloom-scratch."""
    path = f"{shared_dir(spark)}/sparkloom-scratch/{uuid.uuid4().hex}-{name}"
    _WRITTEN.append(path)
    return path


def durable(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there.

    This cuts the lineage: a lost executor costs only the tasks it was running,
    and what later steps read cannot change between two evaluations.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system, before the worker waits for its next group."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows of a few numbers that may be broadcast; a table above that is joined by a shuffle.
BROADCAST_ROWS = 300_000


def sized(written: DataFrame) -> DataFrame:
    """A table of narrow rows that durable() has written, to be broadcast if it is small (counting it reads footers only)."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def written() -> list[str]:
    """What the operators have written to the shared folder and nothing has deleted."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these paths, or all that the operators wrote; results that read them can't be read afterwards."""
    for name in written() if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="sparkloom-zip-")) / f"{root.name}.zip"
    path.write_bytes(out.getvalue())
    sc.addPyFile(str(path))
    sc._sparkloom_shipped = True


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, as ``id`` bigint and ``text`` string; so no other column's name can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LAST = (1 << 63) - 1


def id_key():
    """Sort key of an id: null ids come last."""
    return F.coalesce(F.col("id"), F.lit(LAST))


def running_offsets(totals: DataFrame, key: str, value: str) -> DataFrame:
    """totals with ``before``: the sum of value over smaller keys.

    The window runs in one task; totals has one row per partition of a job, so
    its size follows the number of partitions, not of rows.
    """
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint"))
