"""Overlaps, inequalities, as-of joins and frames of hot keys, sequences and two-phase aggregates on skewed and null input."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import aggregates
from sparkloom.operators import inequality, intervals, joins, ordering, patterns, windows
from sparkloom.plans import ordered

T0 = datetime.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# numbers


def test_numbers_of_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([None, 1, 2, 3]), i) for i in range(400)]
    got = ordering.numbered(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.col("v").asc(), F.col("i").desc()]).collect()
    groups: dict = {}
    for k, v, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, -x[2])):
        groups.setdefault(k, []).append(i)
    assert {(x.k, x.i): x["__row"] for x in got} == {(k, i): n for k, own in groups.items() for n, i in enumerate(own)}


def test_numbers_without_groups_use_several_tasks(spark):
    own = spark.range(2000).withColumn("v", F.col("id") % 7)
    got = ordering.numbered(own, [], [F.col("v").asc(), F.col("id").asc()])
    assert sorted(r["__row"] for r in got.collect()) == list(range(2000))
    assert ordering.numbered(own.limit(0), [], [F.col("id").asc()]).count() == 0


def test_cells_of_hot_keys(spark):
    a = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    b = spark.createDataFrame([("hot", i) for i in range(70)] + [("b", 5), (None, 6)], "k string, y int")
    want = rows_of(a.join(b, "k"))
    for rows in (1, 7, 60, 1000):
        assert rows_of(ordering.cell_join(a, b, ["k"], rows)) == want


def test_copies_of_cells_grow_with_the_rows(spark, monkeypatch):
    """Twice the rows of a hot key make four times the pairs, and were four times the copies."""
    monkeypatch.setattr(ordering, "TASKS", 16)
    copies = []
    for n in (1000, 2000):
        a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("x"))
        dealt = ordering.cells(a, a.withColumnRenamed("x", "y"), ["k"], 10)
        copies.append(sum(df.count() for df in dealt))
        assert dealt[0].select("__i", "__j").distinct().count() == 16
        assert ordering.cell_join(a, a.withColumnRenamed("x", "y"), ["k"], 10).distinct().count() == n * n
    assert copies == [8 * 1000, 8 * 2000]


# intervals


def overlaps(left, right):
    ok = lambda s: s[1] is not None and s[2] is not None and s[1] < s[2]
    return Counter((a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and a[3] == b[3] and a[3] is not None and a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize("cell", [5, 20_000])
def test_overlaps_of_spans_of_all_lengths(spark, cell):
    r = random.Random(2)

    def spans(n, first):
        rows = []
        for i in range(n):
            a = r.randint(-300, 300)
            rows.append((first + i, a, a + r.choice([-1, 0, 1, 2, 8, 9, 64, 100, 700]), r.choice(["x", "x", "x", "y", None])))
        return [*rows, (first + n, -10**6, 10**6, "x"), (first + n + 1, None, 5, "x"), (first + n + 2, 5, None, "x"), *rows[:3]]

    left, right = spans(150, 0), spans(120, 1000)
    a = spark.createDataFrame(left, "i int, a bigint, b bigint, k string")
    b = spark.createDataFrame(right, "j int, c bigint, d bigint, l string")
    out = intervals.overlap_join(a, b, ("a", "b"), ("c", "d"), [("k", "l")], 4, cell)
    assert out.columns == ["i", "a", "b", "k", "j", "c", "d", "l"]
    assert rows_of(out.select("i", "j")) == overlaps(left, right)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_one_span_over_all_others_is_many_tasks(spark):
    """The row that overlaps all is dealt to cells with the rows that it meets."""
    right = spark.range(3000).select(F.col("id").alias("j"), F.col("id").alias("c"), (F.col("id") + 1).alias("d"))
    left = spark.createDataFrame([(1, -5, 10_000)], "i int, a bigint, b bigint")
    out = intervals.overlap_join(left, right, ("a", "b"), ("c", "d"), width=2, cell=500)
    assert out.count() == 3000
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_overlaps_of_times_and_empty_sides(spark):
    t = lambda m: T0 + datetime.timedelta(minutes=m)
    a = spark.createDataFrame([(1, t(0), t(10)), (2, t(10), t(500))], "i int, a timestamp_ntz, b timestamp_ntz")
    b = spark.createDataFrame([(7, t(9), t(11)), (8, t(-3), t(0)), (9, t(10), t(10))], "j int, c timestamp_ntz, d timestamp_ntz")
    join = lambda x, y: intervals.overlap_join(x, y, ("a", "b"), ("c", "d"), width=60_000_000)
    assert rows_of(join(a, b).select("i", "j")) == Counter([(1, 7), (2, 7)])
    assert join(a.limit(0), b).count() == 0 and join(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError, match="names"):
        intervals.overlap_join(a, a, ("a", "b"), ("a", "b"))


# inequalities

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize(("first", "second", "block"), [("<", ">", 16), ("<=", ">=", 5), (">", "<=", 1), ("<", "<", 1000), (">=", ">", 33)])
def test_inequalities(spark, first, second, block):
    r = random.Random(3)
    # half of the rows share a value
    value = lambda: r.choice([None, 5, 5, 5, 5, *range(-9, 20)])
    left = [(i, value(), value()) for i in range(90)] + [(900, 5, 5)] * 3
    right = [(i, value(), value()) for i in range(70)] + [(901, 5, 5)] * 2
    a = spark.createDataFrame(left, "i int, x int, y int")
    b = spark.createDataFrame(right, "j int, u int, v int")
    out = inequality.inequality_join(a, b, ("x", first, "u"), ("y", second, "v"), block, 50)
    want = Counter((p[0], q[0]) for p in left for q in right if None not in p + q and OPS[first](p[1], q[1]) and OPS[second](p[2], q[2]))
    assert rows_of(out.select("i", "j")) == want
    assert out.columns == ["i", "x", "y", "j", "u", "v"]
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_inequalities_of_empty_sides_and_kinds(spark):
    a = spark.createDataFrame([(1, T0, "b"), (2, T0, None)], "i int, x timestamp_ntz, y string")
    b = spark.createDataFrame([(3, T0 + datetime.timedelta(1), "a"), (4, T0, "a")], "j int, u timestamp_ntz, v string")
    join = lambda p, q: inequality.inequality_join(p, q, ("x", "<", "u"), ("y", ">", "v"))
    assert rows_of(join(a, b).select("i", "j")) == Counter([(1, 3)])
    assert join(a.limit(0), b).count() == 0 and join(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError, match="operators"):
        inequality.inequality_join(a, b, ("x", "=", "u"), ("y", ">", "v"))
    with pytest.raises(ValueError, match="names"):
        inequality.inequality_join(a, a, ("x", "<", "x"), ("y", ">", "y"))


def test_inequality_query_takes_every_urgent_order(spark, tmp_path):
    r = random.Random(8)
    orders = [(i, r.randint(0, 60), r.choice("FOP"), float(r.randint(1, 50)), T0 + datetime.timedelta(r.randint(0, 40)), r.choice(["1-URGENT", "1-URGENT", "5-LOW"])) for i in range(150)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    urgent = [o for o in orders if o[5] == "1-URGENT"]
    want = Counter((a[0], b[0]) for a in urgent for b in urgent if a[4] < b[4] and a[3] >= b[3])
    assert rows_of(ordered.QUERIES["join_inequality"](spark, str(tmp_path))) == want
    assert "%" not in ordered.ORACLES["join_inequality"]


def test_a_task_of_an_inequality_holds_few_pairs(spark, monkeypatch):
    """Two sides that all match: no group that is compared in Python may have more than block**2 / 4 pairs."""
    a = spark.range(6000).select(F.col("id").alias("i"), F.col("id").alias("x"), F.col("id").alias("y"))
    b = spark.range(300).select(F.col("id").alias("j"), (F.col("id") + 10_000).alias("u"), (F.col("id") + 10_000).alias("v"))
    seen = []
    monkeypatch.setattr(inequality, "cell_join", lambda left, right, *a: seen.append((left, right)) or ordering.cell_join(left, right, *a))
    assert inequality.inequality_join(a, b, ("x", "<", "u"), ("y", "<", "v")).count() == 6000 * 300
    assert inequality.BLOCK**2 // 4 <= 1 << 20
    # so nearly all of them are found by the join
    assert ordering.cell_join(*seen[0], ["__b1", "__a1", "__b2", "__a2"], 1000).count() > 4000 * 300


def test_pairs_make_tasks(spark, monkeypatch):
    """A small table with many pairs is dealt by its pairs, not by its bytes."""
    a = spark.range(500).select(F.col("id").alias("i"), (F.col("id") % 10).cast("double").alias("x"))
    b = spark.range(500).select(F.col("id").alias("j"), F.lit(0.0).alias("low"), F.lit(10.0).alias("high"))
    monkeypatch.setattr(ordering, "PAIRS", 5000)
    out = joins.range_join(a, b, "x", "low", "high", 20.0, 50)
    assert out.count() == 250_000
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(per_task) > 20 and max(per_task) < 50_000


def test_short_spans_meet_at_their_own_level(spark, monkeypatch):
    """One long span on each side must not bring all short ones of its bins together."""
    a = spark.range(640).select(F.col("id").alias("i"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1).select(F.lit(-1), F.lit(0), F.lit(640)))
    b = a.toDF("j", "c", "d")
    seen = []
    monkeypatch.setattr(intervals, "cell_join", lambda *x: seen.append(ordering.cell_join(*x)) or seen[-1])
    assert intervals.overlap_join(a, b, ("a", "b"), ("c", "d"), width=1).count() == 640 * 3 + 1
    assert seen[0].count() < 640 * 8


# as-of joins


def asof_by_loop(left, right, seconds=None):
    out = Counter()
    for i, k, t in left:
        ok = [(u, x) for j, k2, u, x in right if k2 == k and u is not None and t is not None and u <= t]
        best = max(ok, key=lambda p: (p[0], p[1] is not None, p[1] or 0), default=None)
        if best and seconds is not None and (t - best[0]).total_seconds() > seconds:
            best = None
        out[(i, k, t, best[1] if best else None)] += 1
    return out


@pytest.mark.parametrize("tolerance", [None, 40])
def test_asof_of_a_hot_key(spark, tolerance):
    r = random.Random(4)
    key = lambda: r.choice(["hot"] * 9 + ["a", "b", None])
    at = lambda: T0 + datetime.timedelta(seconds=r.randint(0, 900))
    left = [(i, key(), at()) for i in range(200)] + [(500, "hot", None), (501, None, T0)] + [(502, "hot", T0)] * 3
    right = [(i, key(), at(), i) for i in range(60)] + [(600, "hot", None, 1), (601, "hot", T0, None), (602, "hot", T0, 7)]
    a = spark.createDataFrame(left, "i int, k string, ts timestamp_ntz")
    b = spark.createDataFrame(right, "j int, k string, ts timestamp_ntz, x int")
    got = rows_of(joins.asof_ranged(a, b, "ts", ["k"], ["x"], tolerance and f"{tolerance} seconds"))
    assert got == asof_by_loop(left, right, tolerance)


def test_asof_of_one_key_uses_several_tasks(spark):
    """All rows have one key; the only right row comes first, so it must be carried over every border."""
    n = 4000
    a = spark.range(n).select(F.col("id").alias("i"), F.lit(1).alias("k"), (F.col("id") + 1).alias("ts"))
    b = spark.createDataFrame([(1, 0, "first")], "k int, ts bigint, x string")
    out = joins.asof_ranged(a, b, "ts", ["k"], ["x"])
    assert out.filter("x = 'first'").count() == n
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
    none = joins.asof_ranged(a, b.limit(0), "ts", ["k"], ["x"])
    assert none.filter("x is null").count() == n and joins.asof_ranged(a.limit(0), b, "ts", [], ["x"]).count() == 0


# frames


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_frames_of_hot_groups(spark, rows):
    r = random.Random(5)
    data = [(i, r.choice(["hot"] * 9 + ["a", None]), r.randint(0, 50), r.choice([None, 1.5, 2.0, 7.0])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, k string, t int, v double")
    columns = {"n": F.count("v"), "high": F.max("v"), "first": F.first("i"), "last": F.last("i")}
    got = {r.i: (r.n, r.high, r.first, r["last"]) for r in windows.row_frame(df, ["k"], [F.col("t").asc(), F.col("i").asc()], 3, 1, columns, rows).collect()}
    want = {}
    for k in {x[1] for x in data}:
        own = sorted((x for x in data if x[1] == k), key=lambda x: (x[2], x[0]))
        for p, x in enumerate(own):
            frame = own[max(0, p - 3) : p + 2]
            values = [y[3] for y in frame if y[3] is not None]
            want[x[0]] = (len(values), max(values, default=None), frame[0][0], frame[-1][0])
    assert got == want
    with pytest.raises(ValueError, match="frame"):
        windows.row_frame(df, ["k"], [F.col("i").asc()], -1, 0, columns)


# sequences


def sequences_by_loop(rows, steps, seconds):
    out = Counter()
    for u in {r[1] for r in rows}:
        state = [None] * len(steps)
        for i, _, t, kind in sorted((r for r in rows if r[1] == u and r[2] is not None), key=lambda r: (r[2], r[0])):
            if kind == "error":
                state = [None] * len(steps)
                continue
            for k in reversed(range(len(steps))):
                if kind == steps[k]:
                    before = (t, ()) if k == 0 else state[k - 1]
                    if before is None:
                        continue
                    if k < len(steps) - 1:
                        state[k] = (before[0], (*before[1], i))
                    elif (t - before[0]).total_seconds() <= seconds:
                        out[(u, *before[1], i)] += 1
    return out


@pytest.mark.parametrize(("steps", "seconds"), [(["view", "purchase"], 100), (["view", "click", "purchase"], 300), (["view", "view", "purchase"], 60)])
def test_sequences_of_a_hot_user(spark, steps, seconds):
    r = random.Random(6)
    kinds = ["view", "click", "purchase", "error", "other", None]
    rows = [(i, r.choice([1] * 8 + [2, None]), T0 + datetime.timedelta(seconds=r.randint(0, 2000)), r.choice(kinds)) for i in range(600)] + [(700, 1, None, "view")]
    df = spark.createDataFrame(rows, "id bigint, u int, ts timestamp_ntz, kind string")
    named = {f"s{k}": F.col("kind") == s for k, s in enumerate(steps)}
    got = patterns.event_sequences(df, ["u"], "ts", "id", named, F.col("kind") == "error", seconds)
    want = sequences_by_loop(rows, steps, seconds)
    assert want and rows_of(got) == want
    assert patterns.event_sequences(df.limit(0), ["u"], "ts", "id", named, F.col("kind") == "error", seconds).count() == 0


# two-phase aggregates


def test_two_phases(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 9 + ["a", None]), r.choice([None, -1.0, 2.0, 8.0])) for _ in range(500)] + [("none", None), ("none", -3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = aggregates.geometric_means(df, "k", "v", "mean")
    want = {}
    for k in {x[0] for x in rows}:
        own = [v for x, v in rows if x == k and v is not None and v > 0]
        product = 1.0
        for v in own:
            product *= v ** (1 / len(own))
        want[k] = product if own else 0.0
    assert {r.k: round(r["mean"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}
    text = plan(out)
    # the Python step lies below the shuffle
    assert text.index("Exchange") < text.index("MapInArrow")
    assert aggregates.geometric_means(df.limit(0), "k", "v", "mean").count() == 0


def test_two_phases_of_many_keys(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").cast("double").alias("v"))
    out = aggregates.two_phases(df, "k", "v", {"min_v": "double", "max_v": "double", "sum_n": "bigint"}, lambda x: (x.min(), x.max(), len(x)), {"low": F.col("min_v"), "high": F.col("max_v"), "n": F.col("sum_n")}, states=50)
    assert rows_of(out) == rows_of(df.groupBy("k").agg(F.min("v"), F.max("v"), F.count("v")))
    with pytest.raises(ValueError, match="begin"):
        aggregates.two_phases(df, "k", "v", {"v": "double"}, lambda x: (1,), {})
