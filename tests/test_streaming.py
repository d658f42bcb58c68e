"""Late rows, repeated batches, and folders that a cluster must name."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tables
from sparkloom.streaming import events, timers

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def written(spark, folder, batches):
    """A table of one file for each batch, the first one the oldest."""
    at = lambda m: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)
    os.makedirs(f"{folder}/events.parquet")
    for k, minutes in enumerate(batches):
        rows = [(100 * k + i, at(m), m % 3, "view", float(m), "{}") for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/one{k}")
        part = next(p for p in os.listdir(f"{folder}/one{k}") if p.endswith(".parquet"))
        os.rename(f"{folder}/one{k}/{part}", f"{folder}/events.parquet/{k}.parquet")
        os.utime(f"{folder}/events.parquet/{k}.parquet", (1_700_000_000 + 60 * k,) * 2)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    # 5 minutes past ten comes two batches after 12:50, more than the delay of ten minutes late; 12:45 is late but in time
    written(spark, tmp_path, [[0, 1, 170], [171], [5, 165], [400], [401]])
    own = events.events(spark, str(tmp_path), files_at_once=1).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    out = events.drained(own.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))
    got = {r.start.hour: r.n for r in out.collect()}
    assert got == {10: 2, 12: 3}


def test_state_over_batches(spark, tmp_path):
    written(spark, tmp_path, [[0, 3], [6], [9, 1]])
    own = events.events(spark, str(tmp_path), None, files_at_once=1)
    out = events.updates(own.groupBy("user_id").agg(F.count("*").alias("n")))
    assert sorted((r.user_id, r.n) for r in out.groupBy("user_id").agg(F.max("n").alias("n")).collect()) == [(0, 4), (1, 1)]


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master = "spark://one:7077"

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)
    Context.master = "local[2]"
    assert os.path.isdir(tables.shared_folder(Session))


def stamp(m):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)


def test_inactivity_with_late_rows_and_a_restart(spark, tmp_path):
    """The stream stops after each file and goes on from its checkpoint; a row that is late but in time prevents an alert."""
    base, folder = str(tmp_path / "base"), tmp_path / "in"
    # user m % 3; an alert after 30 minutes; delay 10 minutes
    batches = [[0, 1, 3], [38], [31, 46], [200], [2, 203], [400]]
    seen: list = []
    os.makedirs(folder)
    for k, minutes in enumerate(batches):
        written(spark, tmp_path / f"b{k}", [minutes])
        os.makedirs(folder / "events.parquet", exist_ok=True)
        os.rename(tmp_path / f"b{k}/events.parquet/0.parquet", folder / f"events.parquet/{k}.parquet")
        own = timers.inactivity(events.events(events.stateful_session(spark), str(folder)), 30 * 60)
        out = timers.run_to(spark, own, base)
        seen.append(sorted((r.user_id, r.last_micros) for r in out.collect()))
    told = {(u, (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=t) - stamp(0)).seconds // 60) for u, t in seen[-1]}
    # 31 comes after 38, before the watermark passes it, and follows 1 within 30 minutes; 2 comes behind the watermark and is dropped
    assert told == {(0, 3), (1, 46), (2, 38), (2, 203)}
    assert len(seen[-1]) == len(set(seen[-1]))
    # nothing is told before the watermark allows it, and nothing is taken back
    assert seen[0] == [] and all(set(a) <= set(b) for a, b in zip(seen, seen[1:], strict=False))


def test_state_is_forgotten(spark, tmp_path):
    """An id that comes again after its time to live counts as new; within it, it doesn't."""
    base, folder = str(tmp_path / "base"), tmp_path / "in"
    os.makedirs(folder)

    def step(k, milliseconds, pause=0):
        time.sleep(pause)
        written(spark, tmp_path / f"b{k}", [[7, 8]])
        os.makedirs(folder / "events.parquet", exist_ok=True)
        os.rename(tmp_path / f"b{k}/events.parquet/0.parquet", folder / f"events.parquet/{k}.parquet")
        rows = events.events(events.stateful_session(spark, False), str(folder), None)
        return timers.run_to(spark, timers.seen_lately(rows, milliseconds, 2), base).count()

    assert [step(0, 4000), step(1, 4000), step(2, 4000, 6)] in ([2, 2, 4], [2, 4, 6])
    base = str(tmp_path / "other")
    assert [step(3, 3_600_000), step(4, 3_600_000)] == [2, 2]


def test_stateful_streams_leave_the_session_alone(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    assert "RocksDB" in events.stateful_session(spark).conf.get(key) and spark.conf.get(key) == before


def test_ids_seen_cost_calls_by_runs():
    """Two calls to the state for 256 neighbouring ids; each id of a run has its own time to live."""
    import pandas as pd

    class State(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    own = timers.SeenLately(1000)
    own.runs = State()
    rows = lambda ids: pd.DataFrame({"event_id": ids, "user_id": 1, "event_type": "x"})
    ids = [*range(-300, 5000)]
    assert own.fresh([rows(ids), rows(ids)], 0)["event_id"].tolist() == ids
    assert own.runs.calls < 100
    assert own.fresh([rows([7, 9000, 7])], 600)["event_id"].tolist() == [9000]
    assert own.fresh([rows([5100])], 900)["event_id"].tolist() == [5100]
    assert own.fresh([rows([7, 9000, 5100])], 1100)["event_id"].tolist() == [7]
    assert own.fresh([rows([7, 9000, 5100])], 1950)["event_id"].tolist() == [9000, 5100]
