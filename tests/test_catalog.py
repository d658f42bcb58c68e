"""Every registered plan gives what DuckDB gives for its SQL on the same tables."""

import datetime
import math

import pytest

from sparkloom.plans import catalog


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    other = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, other.fetchall())


def test_every_plan_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_filter_reaches_the_scan(spark, sf):
    plan = catalog.queries()["filter_pushdown"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan
    assert "o_orderpriority" not in plan


def test_dot_takes_every_query_row(spark, tmp_path):
    from sparkloom.plans import catalog

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 3.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["functions_dot"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0.0), (0, 0, 0.0), (0, 0, 1.0), (0, 0, 1.0), (1, 0, 2.0), (1, 0, 3.0)]


def test_cosine_blocks_follow_the_queries(spark, tmp_path, monkeypatch):
    from sparkloom.plans import relational

    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(tuple(r) for r in catalog.queries()["functions_cosine"](spark, str(tmp_path)).collect())
    monkeypatch.setattr(relational, "QUERIES_AT_ONCE", 3)
    got = sorted(tuple(r) for r in catalog.queries()["functions_cosine"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 400 * 20


def test_cosines_of_odd_vectors_in_many_tiles(spark):
    from pyspark.sql import functions as F

    from sparkloom.operators import vectors

    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [-4.0, 3.0]), (6, []), (7, [4.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for queries, stripe in ((1, 2), (100, 100)):
        out = vectors.cosines(df, df.filter("vec_id in (0, 1, 5)"), "vec_id", "embedding", queries, stripe)
        got = {(r.vec_id, r.query_id): plain(r.cosine) for r in out.collect()}
        assert len(got) == len(rows) * 3 and out.count() == len(rows) * 3
        assert [got[i, 0] for i in range(8)] == ["1", "nan", "None", "None", "None", "0", "None", "0.96"]
        assert got[1, 1] == "nan" and got[5, 1] == "nan" and got[7, 5] == "-0.28"
    # many tasks, although the tables are small
    many = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = vectors.cosines(many, many.filter("vec_id < 100"), "vec_id", "embedding", 10, 10)
    assert out.count() == 40_000 and out.groupBy(F.spark_partition_id().alias("p")).count().count() > 20


def test_lateral_limit_is_ordered_by_its_window(spark, tmp_path):
    """The first order of each customer doesn't hang on the order in which a shuffle delivers rows; nulls come last."""
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(None, 1, 5.0), (10, 1, 5.0), (11, 1, None), (9, 1, 5.0), (12, 2, None), (13, 2, -1.0), (14, None, 9.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.queries()["subquery_lateral"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 9), (2, 13)]
    windows = [line for line in plan_of(df).splitlines() if "windowspecdefinition" in line]
    assert windows and all("o_totalprice" in line for line in windows)


def test_sketches_are_apart_from_the_exact_count(spark, sf):
    """Beside a distinct count Spark groups by the counted value too, so there would be a sketch for each user."""
    plan = plan_of(catalog.queries()["aggregate_approximate"](spark, sf))
    assert plan.count("approx_count_distinct") and not [x for x in plan.splitlines() if "keys=[event_type" in x and "user_id" in x.split("functions=")[0] and "approx" in x]


def test_bucketed_tables_are_replaced_and_need_no_shuffle(spark, sf):
    from sparkloom.sources import tables

    for _ in range(2):
        df = catalog.queries()["source_bucketed"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(o_orderkey" not in plan and "hashpartitioning(l_orderkey" not in plan
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("sparkloom_") and not t.isTemporary]
    assert len(names) == 2
    before = len(tables.written())
    own = tables.durable(spark.range(3).toDF("x"), "some")
    path = tables.written()[-1]
    assert len(tables.written()) == before + 1 and own.count() == 3
    tables.release(spark, [path])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_funnel_arguments(spark):
    from sparkloom.functions.tables import Funnel

    from pyspark.sql import functions as F

    spark.udtf.register("funnel_of", F.udtf(Funnel))
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, k), u, t) for k, (u, t) in enumerate([(7, "b"), (7, "a"), (7, "a"), (7, "b"), (None, "a"), (8, "c")])], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").createOrReplaceTempView("funnel_rows")
    one = spark.sql("select * from funnel_of(table(funnel_rows), 'a')")
    two = spark.sql("select * from funnel_of(table(funnel_rows), 'a,b')")
    assert one.columns == ["user_id", "first_a"] and two.columns == ["user_id", "first_a", "first_b"]
    minutes = {r.user_id: (r.first_a and r.first_a.minute, r.first_b and r.first_b.minute) for r in two.collect()}
    assert minutes == {7: (1, 3), None: (4, None), 8: (None, None)}
    for wrong in ("'a,a'", "cast(null as string)"):
        with pytest.raises(Exception, match="steps"):
            spark.sql(f"select * from funnel_of(table(funnel_rows), {wrong})").collect()
