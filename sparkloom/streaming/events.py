"""Streaming plans over the event table.

Each reads the table as a stream, runs once over what is there (availableNow)
into a Parquet sink with a checkpoint, and returns what the sink holds, so the
result can be compared with SQL.  Append mode keeps back windows that the
watermark hasn't closed; the SQL leaves out the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.sources.tables import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def events(spark: SparkSession, d: str, delay: str | None = "10 minutes", files_at_once: int | None = None) -> DataFrame:
    """The events as a stream; watermarks need a timestamp with time zone.  files_at_once bounds the files of a batch."""
    path = f"{d}/events.parquet"
    # a stream reads a folder or a pattern, so a table that is one file is named by a pattern
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    stream = reader.parquet(f"{d}/event[s].parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", delay) if delay else stream


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns the sink's rows."""
    spark = df.sparkSession
    base = scratch(spark, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def query(sql: str) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL)
SELECT window_start, event_type, n, total FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    out = drained(own.select(F.col("window.start").alias("window_start"), "event_type", "n", "total"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b FROM events),
s AS (SELECT b - INTERVAL '30 minutes' AS window_start FROM w UNION ALL SELECT b FROM w)
SELECT window_start, count(*) AS n FROM s WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events) GROUP BY window_start
""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return drained(own.select(F.col("window.start").alias("window_start"), "n")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
e AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, no)
SELECT user_id, session_start, session_end, n FROM e WHERE session_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    out = drained(own.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    twice = events(spark, d, None).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withWatermark("ts", "10 minutes")
    return drained(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"))


@query("""
SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id
AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL '1 hour' WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    views = events(spark, d).filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("view_user"), F.col("ts").alias("view_ts"))
    bought = events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    near = F.expr("user_id = view_user and ts >= view_ts and ts <= view_ts + interval 1 hour")
    return drained(views.join(bought, near).select("view_id", "purchase_id"))


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for b in batches:
        n, total = n + len(b), total + float(b["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_custom_state(spark: SparkSession, d: str) -> DataFrame:
    """Counts per user in state of its own; the last of each user's updates."""
    own = events(spark, d, None).groupBy("user_id").applyInPandasWithState(_count, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
    return updates(own).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def updates(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Runs the stream over what is there in update mode and returns all batches' rows; a batch that is repeated replaces what it wrote before."""
    spark = spark or df.sparkSession
    base = scratch(spark, "stream")
    writer = df.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stateful_session(spark: SparkSession, idle_batches: bool = True) -> SparkSession:
    """A session of the same application whose state lies in RocksDB; other streams and the caller's settings stay as they are.

    Batches without rows move timers in event time; with times of the clock they would never end, so these do without.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class LastSeen(StatefulProcessor):
    """Of each key the number of rows and the largest value so far, in two values of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint, high double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, high = self.seen.get() if self.seen.exists() else (0, float("-inf"))
        for b in rows:
            n, high = n + len(b), max(high, float(b["value"].max()))
        self.seen.update((n, high))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "high": [high]})

    def close(self) -> None:
        pass


@query("SELECT user_id, count(*) AS n, max(value) AS high FROM events GROUP BY user_id")
def stream_transform_state(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stateful processor, whose state is kept by RocksDB."""
    own = events(stateful_session(spark), d, None).groupBy("user_id").transformWithStateInPandas(LastSeen(), "user_id bigint, n bigint, high double", "Update", "None")
    return updates(own, spark).groupBy("user_id").agg(F.max("n").alias("n"), F.max("high").alias("high"))
