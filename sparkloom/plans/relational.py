"""Relational queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import aggregates, columns
from sparkloom.operators import joins, vectors, windows
from sparkloom.sources.tables import register, scan, scratch, sink, sink_bucketed, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Vectors of a query block, about a quarter of a kilobyte each.
QUERIES_AT_ONCE = 256


def query(sql: str):
    """Registers a plan under its function's name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def exact_sum(x: Column) -> Column:
    """A sum of doubles taken in decimals, so that the order of rows can't change its last digits."""
    return F.sum(x.cast("decimal(18,4)")).cast("double")


@query("""
SELECT c_mktsegment, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY c_mktsegment
""")
def revenue_by_segment(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz '1998-01-01'")
    joined = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


# scans, projections, filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' AND o_totalprice > 1000")
def filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1997-01-01' and o_orderstatus = 'F' and o_totalprice > 1000")
    return own.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%7' AND c_acctbal BETWEEN 0 AND 5000")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").like("%7") & F.col("c_acctbal").between(0, 5000)).select("c_custkey", "c_name")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS sum_base, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS sum_disc,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    own = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return own.agg(
        exact_sum(F.col("l_quantity")).alias("sum_qty"), exact_sum(F.col("l_extendedprice")).alias("sum_base"), exact_sum(price).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"),
    )


# joins


def _orders_lines(spark: SparkSession, d: str, how: str, extra: bool = False) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return o.join(li, on & (F.col("l_quantity") > 25) if extra else on, how)


@query("SELECT o_orderkey, l_partkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return _orders_lines(spark, d, "left").select("o_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_orderkey, l_partkey, l_linenumber FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "right")
    return own.select("o_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_orderkey, l_orderkey, l_partkey, l_linenumber FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    return _orders_lines(spark, d, "full", True).select("o_orderkey", "l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return _orders_lines(spark, d, "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return _orders_lines(spark, d, "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    # two dimension tables of fixed size
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))
    return a.join(b, on).select(F.col("a.s_suppkey").alias("low"), F.col("b.s_suppkey").alias("high"))


@query("""
SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    v = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof_backward(p, v, "ts", ["user_id"], ["view_id"]).select("purchase_id", "view_id")


@query("""
SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE v.ts >= p.ts - INTERVAL '1 day'
""")
def join_asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    v = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof_backward(p, v, "ts", ["user_id"], ["view_id"], "1 day").filter("view_id is not null").select("purchase_id", "view_id")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 20")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.range_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), s, "c_acctbal", "low", "high", 20.0).select("c_custkey", "s_suppkey")


@query("SELECT event_type, count(*) AS n FROM events JOIN (SELECT user_id, count(*) AS seen FROM events GROUP BY user_id HAVING count(*) > 5) u USING (user_id) GROUP BY event_type")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    u = e.groupBy("user_id").agg(F.count("*").alias("seen")).filter("seen > 5")
    return joins.salted_join(e, u, "user_id", 4).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def subquery_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Orders are ranked before the lateral step: for a limit inside it, Spark sorts the table and then deals it anew by customer, which keeps no order."""
    register(spark, d, "customer", "orders")
    ranked = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey nulls last) as place from orders"
    return spark.sql(f"with ranked as ({ranked}) select c_custkey, o_orderkey from customer, lateral (select o_orderkey from ranked where o_custkey = c_custkey and place = 1)")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) GROUP BY o_orderpriority")
def subquery_exists(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders", "lineitem")
    return spark.sql("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49) group by o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)")
def subquery_scalar(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "customer")
    return spark.sql("select c_custkey, c_acctbal from customer c where c_acctbal > (select avg(c_acctbal) from customer i where i.c_nationkey = c.c_nationkey)")


@query("""
SELECT n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name
""")
def join_many(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    own = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.join(table(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    own = own.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("n_name").agg(exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


# aggregation


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def aggregate_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def aggregate_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact_sum(F.col("l_quantity")).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def aggregate_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def aggregate_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "lineitem")
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def aggregate_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).filter("n > 10")


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS mid, round(quantile_cont(c_acctbal, 0.9), 4) AS high, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS var FROM customer GROUP BY c_mktsegment")
def aggregate_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    middle = windows.exact_percentiles(c, "c_mktsegment", "c_acctbal", {"mid": 0.5, "high": 0.9})
    spread = c.groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_pop("c_acctbal"), 2).alias("var"))
    return middle.join(spread, "c_mktsegment").select("c_mktsegment", F.round("mid", 4).alias("mid"), F.round("high", 4).alias("high"), "sd", "var")


@query("SELECT c_mktsegment, quantile_disc(c_acctbal, 0.25) AS low, quantile_disc(c_acctbal, 0.5) AS mid, round(median(c_acctbal), 4) AS median FROM customer GROUP BY c_mktsegment")
def aggregate_percentile_disc(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    own = windows.exact_percentiles(c, "c_mktsegment", "c_acctbal", {"low": 0.25, "mid": 0.5}, discrete=True)
    return own.join(windows.exact_percentiles(c, "c_mktsegment", "c_acctbal", {"median": 0.5}), "c_mktsegment").withColumn("median", F.round("median", 4))


@query("SELECT n_regionkey, quantile_disc(n_nationkey, 0.5) AS mid, median(n_nationkey) AS median FROM nation GROUP BY n_regionkey")
def aggregate_percentile_small(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own functions, for groups of a fixed size."""
    register(spark, d, "nation")
    return spark.sql("select n_regionkey, cast(percentile_disc(0.5) within group (order by n_nationkey) as int) as mid, median(n_nationkey) as median from nation group by n_regionkey")


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS users_near, true AS middle_near FROM events GROUP BY event_type")
def aggregate_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of a fixed size for each group: distinct users and the median, and whether both are within their stated errors."""
    e = table(spark, d, "events")
    # apart from the exact count, beside which there would be a sketch for each group and user
    own = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("about"), F.percentile_approx("value", 0.5, 10_000).alias("middle"), F.count("value").alias("n"))
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    # five groups, a row each
    below = e.join(F.broadcast(own.select("event_type", "middle")), "event_type").groupBy("event_type").agg(F.count(F.when(F.col("value") <= F.col("middle"), 1)).alias("upto"), F.count(F.when(F.col("value") < F.col("middle"), 1)).alias("under"))
    near = (F.col("under") <= 0.501 * F.col("n") + 1) & (F.col("upto") >= 0.499 * F.col("n") - 1)
    return own.join(exact, "event_type").join(below, "event_type").select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("users_near"), near.alias("middle_near"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def aggregate_group_by_all(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders")
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) as n from orders group by all")


@query("SELECT event_type, sum(value) FILTER (WHERE value > 50) IS NOT NULL AS has_large, count(*) FILTER (WHERE value > 50) AS large, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def aggregate_filtered(spark: SparkSession, d: str) -> DataFrame:
    large = F.when(F.col("value") > 50, 1)
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(large).isNotNull().alias("has_large"), F.count(large).alias("large"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts) AS path FROM events GROUP BY user_id")
def aggregate_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["event_type"]), ",").alias("path"))


@query("SELECT user_id, arg_max(event_type, ts) AS last_type, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id")
def aggregate_arg_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("""
SELECT c_mktsegment, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F'), 0)::DOUBLE AS f, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'O'), 0)::DOUBLE AS o
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    wide = own.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O"]).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    return wide.select("c_mktsegment", F.coalesce(F.col("F").cast("double"), F.lit(0.0)).alias("f"), F.coalesce(F.col("O").cast("double"), F.lit(0.0)).alias("o"))


@query("SELECT s_suppkey, 'nation' AS name, s_nationkey::DOUBLE AS number FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def unpivot_supplier(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return own.unpivot(["s_suppkey"], ["nation", "balance"], "name", "number")


# windows


@query("""
SELECT event_id, rank() OVER w AS rk, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS nt,
round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)
""")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    own = windows.ranked(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value", "event_id")
    # the last row of equal values has the largest row number of them: rank plus their number less one
    ties = own.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("__ties"))
    own = own.join(ties, ["event_type", "value"])
    r, total = F.col("__rank"), F.col("__total")
    return own.select(
        "event_id", r.alias("rk"), F.col("__dense").alias("dr"), F.col("__row").alias("rn"), windows.tile(F.col("__row"), total, 4).alias("nt"),
        F.round(F.when(total > 1, (r - 1) / (total - 1)).otherwise(0.0), 6).alias("pr"), F.round((r - 1 + F.col("__ties")) / total, 6).alias("cd"),
    )


@query("""
SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nt,
round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)
""")
def window_ranks_per_customer(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own window functions, for many small groups."""
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    b = lambda c: c.cast("bigint")
    return table(spark, d, "orders").select(
        "o_orderkey", b(F.rank().over(w)).alias("rk"), b(F.dense_rank().over(w)).alias("dr"), b(F.row_number().over(u)).alias("rn"), b(F.ntile(4).over(u)).alias("nt"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def window_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2, "none").over(w).alias("after"), F.first("event_id").over(w).alias("first"), F.nth_value("event_id", 2).over(whole).alias("second"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS high FROM events")
def window_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-3, 1)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), F.max("value").over(w).alias("high"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '2 hours' PRECEDING AND CURRENT ROW) AS n FROM events")
def window_range(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "event_type", "ts")
    return windows.trailing_count(own, "event_type", "ts", 7200, "n").select("event_id", "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2 days' PRECEDING AND CURRENT ROW) AS n FROM events")
def window_range_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own range frame, for many small groups."""
    register(spark, d, "events")
    return spark.sql("select event_id, count(*) over (partition by user_id order by ts range between interval 2 days preceding and current row) as n from events")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return joins.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY start")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, event_type FROM events), s AS (SELECT b - INTERVAL '30 minutes' AS start, event_type FROM w UNION ALL SELECT b, event_type FROM w)
SELECT start, event_type, count(*) AS n FROM s GROUP BY start, event_type
""")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS fresh FROM events),
s AS (SELECT user_id, ts, value, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n, max(value) AS high FROM s GROUP BY user_id, no
""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return own.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n", "high")


# set operations


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))


@query("SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.union(b)


@query("SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersect(b)


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.subtract(b)


@query("SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders")
def set_except_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return b.exceptAll(a)


@query("SELECT l_orderkey AS k FROM lineitem INTERSECT ALL SELECT o_orderkey FROM orders")
def set_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return b.intersectAll(a)


@query("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(n AS BIGINT) AS n, count(p_partkey) AS parts FROM t LEFT JOIN part ON p_size = n GROUP BY n")
def recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "part")
    return spark.sql("with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select cast(n as bigint) as n, count(p_partkey) as parts from t left join part on p_size = n group by n")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus")
def pipe_syntax(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders")
    return spark.sql("from orders |> where o_totalprice > 50000 |> aggregate count(*) as n group by o_orderstatus")


# functions


@query("""
SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, substr(c_name, 3, 4) AS s, replace(c_name, '0', 'o') AS r, regexp_replace(c_name, '[0-9]+', '#', 'g') AS rx, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p,
strpos(c_name, '0') AS at, reverse(c_name) AS v, concat_ws('-', c_mktsegment, c_name) AS j, split_part(c_name, '#', 2) AS sp, md5(c_name) AS h FROM customer
""")
def functions_string(spark: SparkSession, d: str) -> DataFrame:
    n, b = F.col("c_name"), lambda c: c.cast("bigint")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(n).alias("u"), F.lower(n).alias("l"), b(F.length(n)).alias("n"), F.substring(n, 3, 4).alias("s"), F.replace(n, F.lit("0"), F.lit("o")).alias("r"), F.regexp_replace(n, "[0-9]+", "#").alias("rx"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("p"), b(F.instr(n, "0")).alias("at"), F.reverse(n).alias("v"), F.concat_ws("-", "c_mktsegment", n).alias("j"), F.split_part(n, F.lit("#"), F.lit(2)).alias("sp"), F.md5(n).alias("h"),
    )


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS w, date_trunc('month', o_orderdate)::TIMESTAMP AS mo,
date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS age, last_day(o_orderdate) AS ld, strftime(o_orderdate, '%Y-%m') AS f FROM orders
""")
def functions_date(spark: SparkSession, d: str) -> DataFrame:
    t, b = F.col("o_orderdate"), lambda c: c.cast("bigint")
    return table(spark, d, "orders").select(
        "o_orderkey", b(F.year(t)).alias("y"), b(F.month(t)).alias("m"), b(F.day(t)).alias("dd"), b(F.quarter(t)).alias("q"), b(F.dayofweek(t)).alias("w"), F.date_trunc("month", t).cast("timestamp_ntz").alias("mo"),
        b(F.datediff(t, F.lit("1995-01-01").cast("date"))).alias("age"), F.last_day(t).alias("ld"), F.date_format(t, "yyyy-MM").alias("f"),
    )


@query("""
SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS f, round(sqrt(abs(s_acctbal)), 6) AS sq, round(ln(abs(s_acctbal) + 1), 6) AS l, s_suppkey % 7 AS m, sign(s_acctbal)::DOUBLE AS sg,
CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(s_nationkey, 3), -1) AS nk, greatest(s_acctbal, 100) AS g FROM supplier
""")
def functions_math(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.abs(x).alias("a"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.round(F.sqrt(F.abs(x)), 6).alias("sq"), F.round(F.ln(F.abs(x) + 1), 6).alias("l"), (F.col("s_suppkey") % 7).alias("m"), F.signum(x).alias("sg"),
        F.when(x < 0, "debt").when(x < 5000, "low").otherwise("high").alias("band"), F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("nk"), F.greatest(x, F.lit(100.0)).alias("g"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def functions_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", columns.json_number(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def functions_variant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def functions_from_json(spark: SparkSession, d: str) -> DataFrame:
    """With a schema; a field that isn't there is null."""
    own = F.from_json("props", "k bigint, missing string")
    return table(spark, d, "events").select("event_id", own.getField("k").alias("k"), own.getField("missing").alias("missing"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, round(list_max(embedding)::DOUBLE, 6) AS high, list_contains(embedding, 0) AS zero FROM embeddings")
def functions_array(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(total, 4).alias("total"), F.round(F.array_max(e).cast("double"), 6).alias("high"), F.array_contains(e, F.lit(0.0).cast("float")).alias("zero"))


@query("SELECT o_custkey, p.key AS status, p.value AS n FROM (SELECT o_custkey, unnest(map_entries(histogram(o_orderstatus))) AS p FROM orders GROUP BY o_custkey)")
def functions_map(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_custkey", F.explode("m").alias("status", "n"))


@query("SELECT a.vec_id, b.vec_id AS query_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def functions_dot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return e.crossJoin(q).select("vec_id", "query_id", F.round(columns.dot(F.col("embedding"), F.col("q")), 4).alias("dot"))


@query("""
SELECT a.vec_id, b.vec_id AS query_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0
""")
def functions_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The query set of ids divisible by 20 against all rows, in tiles of QUERIES_AT_ONCE queries and some rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.cosines(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", QUERIES_AT_ONCE)


# user functions


@query("SELECT event_type, round(exp(avg(ln(value)) FILTER (WHERE value > 0)), 4) AS gm FROM events GROUP BY event_type")
def udf_grouped_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Groups of any size: states are made in each task and merged."""
    return aggregates.geometric_means(table(spark, d, "events"), "event_type", "value", "gm").withColumn("gm", F.round("gm", 4))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_type, ' '), lambda w: w <> ''), lambda w: w[1]), '') AS i FROM part")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", columns.initials("p_type").alias("i"))


@query("SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS word_no, length(w[i]) AS size FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations) t, range(1, len(w) + 1) AS r(i)")
def udf_table(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("word_sizes", columns.WordSizes)
    register(spark, d, "conversations")
    return spark.sql("select conv_id, turn, word_no, size from conversations, lateral word_sizes(text)")


# sinks and other formats: a round trip through each


def _round_trip(spark: SparkSession, d: str, fmt: str, **options: str) -> DataFrame:
    own = table(spark, d, "supplier")
    path = scratch(spark, fmt)
    sink(own, path, fmt, **options)
    return scan(spark, path, fmt, own.schema, **options)


def _supplier_query(fmt: str, **options: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _round_trip(spark, d, fmt, **options)

    f.__name__ = f"source_{fmt}"
    return query("SELECT * FROM supplier")(f)


source_orc, source_json, source_csv = _supplier_query("orc"), _supplier_query("json"), _supplier_query("csv", header="true")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def source_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "partitioned")
    sink(table(spark, d, "orders"), path, "parquet", by=("o_orderstatus",))
    return scan(spark, path).filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("SELECT r_regionkey || ',' || r_name AS value FROM region")
def source_text(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "text")
    sink(table(spark, d, "region").select(F.concat_ws(",", "r_regionkey", "r_name").alias("value")), path, "text")
    return scan(spark, path, "text")


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def source_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Two tables bucketed alike, which a join on their buckets' key reads without a shuffle."""
    own = f"sparkloom_{hashlib.md5(d.encode()).hexdigest()[:8]}"
    sink_bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), f"{own}_orders", scratch(spark, "orders"), 8, "o_orderkey")
    sink_bucketed(table(spark, d, "lineitem").select("l_orderkey"), f"{own}_lines", scratch(spark, "lines"), 8, "l_orderkey")
    o, li = spark.table(f"{own}_orders"), spark.table(f"{own}_lines")
    return o.join(li.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
