"""Upserts that fail, repeat or meet, and sketches against exact values on skewed and null input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sketches
from sparkloom.sources import upserts

SCHEMA = "k int, p string, v string, at int"
KEYS = ["p", "k"]


def put(spark, path, rows, batch):
    return upserts.upsert(spark.createDataFrame(rows, SCHEMA), path, batch, KEYS, "p", "at")


def held(spark, path, version=None):
    return Counter(tuple(r) for r in upserts.snapshot(spark, path, version).collect())


def test_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = [(1, "a", "x", 1), (2, "a", "x", 1), (1, "b/=%", "x", 1), (5, None, "n", 1), (None, "a", "null key", 1)]
    assert put(spark, path, first, "one") is True
    assert held(spark, path) == Counter(first)
    second = [(2, "a", "old", 2), (2, "a", "new", 3), (9, "c", "c", 1), (5, None, "m", 2), (None, "a", "again", 2)]
    assert put(spark, path, second, "two") is True
    want = Counter([(1, "a", "x", 1), (2, "a", "new", 3), (1, "b/=%", "x", 1), (9, "c", "c", 1), (5, None, "m", 2), (None, "a", "again", 2)])
    assert held(spark, path) == want
    # a batch that comes again changes nothing, whatever it holds
    assert put(spark, path, first, "two") is False and held(spark, path) == want
    assert put(spark, path, [], "empty") is True and held(spark, path) == want
    assert held(spark, path, 0) == Counter(first)
    # partitions that a batch doesn't touch keep their files
    m = upserts.Manifest(spark, path)
    assert m.read(0)["partitions"]["b/=%"] == m.read(1)["partitions"]["b/=%"] and m.read(0)["partitions"]["a"] != m.read(1)["partitions"]["a"]
    assert m.clean() == 0 and held(spark, path) == want and m.versions() == [2]
    with pytest.raises(ValueError, match="keys"):
        upserts.upsert(spark.createDataFrame(first, SCHEMA), path, "x", ["k"], "p", "at")
    with pytest.raises(ValueError, match="no version"):
        upserts.snapshot(spark, f"file://{tmp_path}/none")


def test_a_batch_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    put(spark, path, [(1, "a", "x", 1)], "one")
    bad = spark.createDataFrame([(1, "a", "y", 2), (2, "a", "z", 2)], SCHEMA).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        upserts.upsert(bad, path, "two", KEYS, "p", "at")
    assert held(spark, path) == Counter([(1, "a", "x", 1)])
    # the same batch again, now whole
    assert put(spark, path, [(1, "a", "y", 2), (2, "a", "z", 2)], "two")
    assert held(spark, path) == Counter([(1, "a", "y", 2), (2, "a", "z", 2)])
    m = upserts.Manifest(spark, path)
    assert m.clean() >= 1 and held(spark, path) == Counter([(1, "a", "y", 2), (2, "a", "z", 2)])


def test_of_two_writers_one_is_told(spark, tmp_path):
    m = upserts.Manifest(spark, f"file://{tmp_path}/t")
    content = {"version": 0, "partitions": {}, "batches": ["one"], "schema": None}
    m.put(content)
    with pytest.raises(RuntimeError, match="another job"):
        m.put(content | {"batches": ["other"]})
    assert m.read()["batches"] == ["one"]


def test_merged_sketches_keep_their_errors(spark, tmp_path):
    """One day holds most rows and one value most of those; nulls don't count."""
    r = random.Random(1)
    rows = [(0 if r.random() < 0.8 else r.randint(1, 6), r.choice([None, 1, 1, r.randint(0, 20_000)]), r.choice([None, 3.0, 3.0, r.gauss(0, 1)])) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "day int, u int, v double")
    days = sketches.stored(df, ["day"], "u", "v", str(tmp_path / "days"))
    assert days.count() == 7
    for quantile in (0.1, 0.5, 0.9):
        got = sketches.merged(days, [(F.col("day") % 2).alias("odd")], quantile)
        for x in got.collect():
            own = [y for y in rows if y[0] % 2 == x.odd]
            users, values = {y[1] for y in own} - {None}, [y[2] for y in own if y[2] is not None]
            assert x.n == len(own) and abs(x.about - len(users)) <= sketches.COUNT_ERROR * len(users) + 1
            under, upto = sum(v < x.middle for v in values), sum(v <= x.middle for v in values)
            wide = sketches.RANK_ERROR * len(values) + 1
            assert under <= quantile * len(values) + wide and upto >= quantile * len(values) - wide
    none = sketches.stored(df.limit(0), ["day"], "u", "v", str(tmp_path / "none"))
    assert sketches.merged(none, [F.col("day")], 0.5).count() == 0
