"""Stateful processors with event-time timers, and with state that is forgotten after a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.sources.tables import scratch
from sparkloom.streaming.events import events, stateful_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


class Inactivity(StatefulProcessor):
    """An alert for each row of a key that no other row of the key follows within a time.

    The times in question are kept until the watermark has passed their end, so a row that
    comes late, but not behind the watermark, still prevents an alert.  One timer for each
    key stands at the earliest end; when it fires, all ends that the watermark has passed
    are told and forgotten.  State is bounded by a key's rows within the time and the
    watermark's delay.
    """

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "at array<bigint>")

    def due(self, at: int) -> int:
        """Milliseconds at which an end has surely passed."""
        return -(-(at + self.micros) // 1000)

    def kept(self) -> list[int]:
        return list(self.times.get()[0]) if self.times.exists() else []

    def put(self, times: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.times.update((times,))
            self.handle.registerTimer(self.due(times[0]))
        else:
            self.times.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = set(self.kept())
        for b in rows:
            found.update(int(x) for x in b["micros"])
        self.put(sorted(found))
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "last_micros": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times, now = self.kept(), timerValues.getCurrentWatermarkInMs()
        passed = [t for t in times if self.due(t) <= now]
        following = dict(zip(times, [*times[1:], None], strict=True))
        alone = [t for t in passed if following[t] is None or following[t] > t + self.micros]
        self.put(times[len(passed) :])
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(alone), dtype="int64"), "last_micros": pd.Series(alone, dtype="int64")})

    def close(self) -> None:
        pass


def inactivity(rows: DataFrame, seconds: int) -> DataFrame:
    """(user_id, last_micros) of a watermarked stream (user_id, ts): users without a row for ``seconds`` after one, once the watermark tells."""
    own = rows.select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    return own.groupBy("user_id").transformWithStateInPandas(Inactivity(seconds * 1_000_000), "user_id bigint, last_micros bigint", "Append", "EventTime")


def run_to(spark: SparkSession, df: DataFrame, base: str) -> DataFrame:
    """Runs the stream over what is there, going on from the checkpoint in base if there is one; returns all that base holds."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("""
WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
SELECT user_id, ts AS last_seen FROM e WHERE (next IS NULL OR next > ts + INTERVAL '2 days') AND ts + INTERVAL '2 days' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
""")
def stream_inactivity(spark: SparkSession, d: str) -> DataFrame:
    """Users of whom nothing is seen for two days, told by timers in event time."""
    out = run_to(spark, inactivity(events(stateful_session(spark), d), 2 * 86_400), scratch(spark, "inactivity"))
    return out.select("user_id", F.timestamp_micros("last_micros").cast("timestamp_ntz").alias("last_seen"))


#: Rows of a bucket that are looked up together.
LOOKED_UP = 1 << 17


class SeenLately(StatefulProcessor):
    """The first row of each id; ids are forgotten some time after they were seen.

    State is held by runs of 256 neighbouring ids, an entry each: the ids' last bytes with
    the time of the clock at which each was seen, 9 bytes.  So an entry's size is bounded,
    and ids that come in about their order cost two calls to the state a run and not an id.
    A run lives as long as its last new id; within it each id has its own time.
    """

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run bigint", "seen binary", self.milliseconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held, n = timerValues.getCurrentProcessingTimeInMs(), [], 0
        for b in rows:
            held.append(b)
            n += len(b)
            if n >= LOOKED_UP:
                yield self.fresh(held, now)
                held, n = [], 0
        if held:
            yield self.fresh(held, now)

    def fresh(self, batches: list[pd.DataFrame], now: int) -> pd.DataFrame:
        import numpy as np

        own = pd.concat(batches).drop_duplicates("event_id")
        ids = own["event_id"].to_numpy("int64")
        order = np.argsort(ids >> 8, kind="stable")
        runs, start = np.unique(ids[order] >> 8, return_index=True)
        new, kind = np.zeros(len(ids), bool), np.dtype([("low", "u1"), ("at", "<i8")])
        for run, at in zip(runs.tolist(), np.split(order, start[1:]), strict=True):
            seen = np.frombuffer(self.runs.getValue((run,))[0], kind) if self.runs.containsKey((run,)) else np.zeros(0, kind)
            seen = seen[seen["at"] + self.milliseconds > now]
            low = (ids[at] & 255).astype("u1")
            unknown = ~np.isin(low, seen["low"])
            if unknown.any():
                added = np.zeros(int(unknown.sum()), kind)
                added["low"], added["at"] = low[unknown], now
                self.runs.updateValue((run,), (np.concatenate([seen, added]).tobytes(),))
                new[at] = unknown
        return own[new][["event_id", "user_id", "event_type"]]

    def close(self) -> None:
        pass


def seen_lately(rows: DataFrame, milliseconds: int, buckets: int = 64) -> DataFrame:
    """Rows of a stream without those whose event_id came less than the given time before; runs of ids are dealt to buckets, so none of them is a hot key."""
    own = rows.select("event_id", "user_id", "event_type", F.pmod(F.xxhash64(F.shiftright("event_id", 8)), F.lit(buckets)).alias("bucket"))
    return own.groupBy("bucket").transformWithStateInPandas(SeenLately(milliseconds), "event_id bigint, user_id bigint, event_type string", "Append", "ProcessingTime")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice, deduplicated by state that lives for a day of the clock."""
    twice = events(stateful_session(spark, False), d, None).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return run_to(spark, seen_lately(twice, 86_400_000), scratch(spark, "seen"))
