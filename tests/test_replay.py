"""The data source in Python: partitions, replayed blocks with late rows, restarts, and commits that come twice or not at all."""

import datetime
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import replay

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    spark.dataSource.register(replay.ReplaySource)
    path = f"{tmp_path_factory.mktemp('replay')}/events"
    df = spark.range(0, 230, 1, 3).select(F.col("id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    df.write.option("parquet.block.size", 1024).parquet(path)
    return path, Counter(tuple(r) for r in df.collect())


def test_batch(spark, rows):
    path, want = rows
    df = spark.read.format(replay.NAME).load(path)
    assert [t for _, t in df.dtypes] == ["bigint", "timestamp_ntz", "string"]
    assert Counter(tuple(r) for r in df.collect()) == want
    assert df.rdd.getNumPartitions() >= 3
    assert df.select("v").filter("id = 6 or v is null").count() == 47
    one = next(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet"))
    assert 0 < spark.read.format(replay.NAME).load(one).count() < 230
    with pytest.raises(Exception, match="holds no Parquet"):
        spark.read.format(replay.NAME).load(os.path.dirname(path) + "/none")


@pytest.mark.parametrize("late", [0, 1, 7])
def test_blocks(rows, late):
    """Every row comes in one block, its own or, if it is late, the next; a block read again is the same."""
    path, want = rows
    stream = replay.Replay(path, ["id", "ts", "v"], 40, late)
    end = stream.latestOffset()
    blocks = [[tuple(r.values()) for b in stream.read(p) for r in b.to_pylist()] for p in stream.partitions(stream.initialOffset(), end)]
    assert Counter(r for b in blocks for r in b) == want
    assert blocks == [[tuple(r.values()) for b in stream.read(replay.Block(k)) for r in b.to_pylist()] for k in range(end["block"])]
    order = [r for f in replay.files_of(path) for r in [f]]
    assert len(order) == 3 and len(blocks) == 6 + (late > 0)
    if late == 7:
        assert [len(b) for b in blocks][:2] == [34, 34 + 6]
    assert stream.partitions({"block": 2}, {"block": 2}) == []


@pytest.mark.parametrize("late", [0, 1, 7])
def test_many_blocks_share_partitions(rows, late, monkeypatch):
    """Runs of blocks hold the rows of their blocks, in order; a partition names the row groups it needs."""
    path, want = rows
    stream = replay.Replay(path, ["id", "ts", "v"], 2, late)
    monkeypatch.setattr(replay, "PARTITIONS", 10)
    read = lambda p: [tuple(r.values()) for b in stream.read(p) for r in b.to_pylist()]
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert 9 <= len(parts) <= 10 and sum(p.count for p in parts) == 115 + (late > 0)
    assert Counter(r for p in parts for r in read(p)) == want
    for p in parts:
        assert read(p) == [r for k in range(p.number, p.number + p.count) for r in read(replay.Block(k))]


def test_small_batches_share_a_row_group(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    sink = replay.BatchSink(str(tmp_path / "out"))
    sink.commit([sink.write(iter([pa.RecordBatch.from_pydict({"x": [i, -i]}) for i in range(50)]))])
    (file,) = replay.files_of(sink.path)
    assert pq.ParquetFile(file).metadata.num_row_groups == 1 and pq.read_table(file)["x"].to_pylist() == [x for i in range(50) for x in (i, -i)]


def test_a_stream_goes_on_from_its_checkpoint(spark, rows, tmp_path):
    path, want = rows

    def run():
        own = spark.readStream.format(replay.NAME).option("rows", "40").option("late", "7").load(path)
        writer = own.writeStream.format(replay.NAME).option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out")
        writer.trigger(availableNow=True).start().awaitTermination()
        return Counter(tuple(r) for r in spark.read.format(replay.NAME).load(f"{tmp_path}/out").collect())

    assert run() == want
    # nothing new: nothing comes twice
    assert run() == want


def test_a_batch_that_is_committed_twice_counts_once(rows, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    sink = replay.StreamSink(str(tmp_path / "out"))
    first = [sink.write(iter([batch, batch])), sink.write(iter([]))]
    assert replay.files_of(sink.path) == []
    sink.commit(first, 0)
    again = [sink.write(iter([batch]))]
    sink.commit(again, 0)
    sink.commit([sink.write(iter([batch])), None], 1)
    lost = [sink.write(iter([batch]))]
    sink.abort([*lost, None], 2)
    assert len(replay.files_of(sink.path)) == 2
    assert not [f for f in os.listdir(sink.path) if f.startswith(".")]
    import pyarrow.parquet as pq

    assert sum(pq.read_table(f).num_rows for f in replay.files_of(sink.path)) == 6


def test_a_task_that_fails_leaves_nothing(spark, rows, tmp_path):
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(replay.NAME).mode("append").save(str(tmp_path / "out"))
    assert not os.path.isdir(tmp_path / "out") or replay.files_of(str(tmp_path / "out")) == []
