"""Ranks, percentiles and trailing counts over large groups against plain loops."""

import datetime
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.operators import windows

few = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
groups = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5))), max_size=25)


@few
@given(groups)
def test_ranked(spark, data):
    rows = [(g, v, i) for i, (g, v) in enumerate(data)]
    got = Counter(tuple(r) for r in windows.ranked(spark.createDataFrame(rows, "g string, v int, i int"), "g", "v", "i").collect())
    want = Counter()
    for g, v, i in rows:
        key = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first
        own = [(key(w), j) for h, w, j in rows if h == g]
        want[(g, v, i, 1 + sum(k < key(v) for k, _ in own), 1 + len({k for k, _ in own if k < key(v)}), 1 + sum((k, j) < (key(v), i) for k, j in own), len(own))] += 1
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 101])
@pytest.mark.parametrize("tiles", [1, 3, 4, 10])
def test_tile(spark, n, tiles):
    got = [r[0] for r in spark.range(1, n + 1).select(windows.tile(windows.F.col("id"), windows.F.lit(n), tiles)).collect()]
    assert got == [r[0] for r in duckdb.sql(f"select ntile({tiles}) over (order by range) from range({n}) order by range").fetchall()]


@few
@given(groups)
def test_percentiles(spark, data):
    c = duckdb.connect()
    c.execute("create table t(g varchar, v integer)")
    if data:
        c.executemany("insert into t values (?, ?)", data)
    df = spark.createDataFrame(data, "g string, v int")
    for kind, discrete in (("cont", False), ("disc", True)):
        got = {r.g: (r.a, r.b) for r in windows.exact_percentiles(df, "g", "v", {"a": 0.3, "b": 1.0}, discrete).collect()}
        want = {g: (a, b) for g, a, b in c.execute(f"select g, quantile_{kind}(v, 0.3), quantile_{kind}(v, 1.0) from t where v is not null group by g").fetchall()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got)


@few
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 400)), max_size=25))
def test_trailing_count(spark, data):
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(g, start + datetime.timedelta(seconds=s), i) for i, (g, s) in enumerate(data)], "g string, t timestamp_ntz, i int")
    got = {r.i: r.n for r in windows.trailing_count(df, "g", "t", 60, "n").collect()}
    assert got == {i: sum(h == g and s - 60 <= u <= s for h, u in data) for i, (g, s) in enumerate(data)}


def test_trailing_count_of_equal_and_missing_times(spark):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: None if s is None else start + datetime.timedelta(seconds=s)
    data = [("a", 0)] * 5 + [("a", 60), ("a", 61), ("a", None), ("a", None), (None, 0), (None, 30), ("b", None)]
    df = spark.createDataFrame([(g, at(s), i) for i, (g, s) in enumerate(data)], "g string, t timestamp_ntz, i int")
    out = windows.trailing_count(df, "g", "t", 60, "n")
    near = lambda s, u: s is u if None in (s, u) else s - 60 <= u <= s
    assert {r.i: r.n for r in out.collect()} == {i: sum(h == g and near(s, u) for h, u in data) for i, (g, s) in enumerate(data)}
    # no frame is counted row by row
    assert "RangeFrame" not in out._jdf.queryExecution().executedPlan().toString()
