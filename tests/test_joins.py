"""Composed joins against plain loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.operators import joins

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
times = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20)), max_size=15)


@few
@given(times, times)
def test_asof(spark, a, b):
    left = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(a)], "k int, t int, i int")
    right = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(b)], "k int, t int, v int")
    got = sorted(tuple(r) for r in joins.asof_backward(left, right, "t", ["k"], ["v"]).select("i", "v").collect())
    want = []
    for i, (k, t) in enumerate(a):
        fit = [(u, j) for j, (m, u) in enumerate(b) if m == k and u <= t]
        want.append((i, max(fit)[1] if fit else None))
    assert got == want


@few
@given(st.lists(st.floats(-50, 50), max_size=15), st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), max_size=15))
def test_range(spark, values, spans):
    a = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    b = spark.createDataFrame([(j, *s) for j, s in enumerate(spans)], "j int, low double, high double")
    got = sorted((r.i, r.j) for r in joins.range_join(a, b, "x", "low", "high", 7.0).collect())
    assert got == sorted((i, j) for i, x in enumerate(values) for j, (lo, hi) in enumerate(spans) if lo <= x < hi)


def test_salted(spark):
    large = spark.createDataFrame([(0, i) for i in range(50)] + [(1, i) for i in range(5)], "k int, i int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, s string")
    assert joins.salted_join(large, small, "k", 3).groupBy("s").count().orderBy("s").collect() == [("a", 50), ("b", 5)]


def test_salted_joins_only_hot_keys_anew(spark):
    large = spark.createDataFrame([(0, i) for i in range(60)] + [(k, k) for k in range(1, 9)] + [(None, 1)], "k int, i int")
    small = spark.createDataFrame([(k, str(k)) for k in range(10)], "k int, s string")
    out = joins.salted_join(large, small, "k", 3)
    assert out.count() == 68 and out.filter("k = 0").count() == 60 and out.columns == ["k", "i", "s"]
