"""Queries over what is stored between jobs: upserted tables and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import sketches
from sparkloom.sources.replay import NAME, ReplaySource
from sparkloom.sources.tables import scratch, table
from sparkloom.sources.upserts import snapshot, upsert

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a plan under its function's name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
o_totalprice + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 3 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT -o_orderkey - 1, o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 7 = 0
""")
def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority: a first load, a batch of changed and new rows, and the same batch again."""
    path = scratch(spark, "upserted")
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.lit(0).alias("change"))
    own = own.filter("o_orderpriority <> '5-LOW'")
    changed = own.filter("o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey % 3 = 0")
    changed = changed.withColumns({"o_orderstatus": F.lit("F"), "o_totalprice": F.col("o_totalprice") + 1, "change": F.lit(2)})
    added = own.filter("o_orderpriority = '1-URGENT' and o_custkey % 7 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    # an older state of a changed row in the same batch doesn't count
    batch = changed.unionByName(added).unionByName(changed.withColumns({"o_totalprice": F.lit(0.0), "change": F.lit(1)}))
    keys = ["o_orderpriority", "o_orderkey"]
    upsert(own, path, "load", keys, "o_orderpriority", "change")
    for _ in range(2):
        upsert(batch, path, "batch", keys, "o_orderpriority", "change")
    return snapshot(spark, path).select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("""
SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n, true AS users_near, true AS middle_near FROM events GROUP BY ALL
""")
def sketch_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Stored sketches of days, merged into weeks without the events; and whether they are within their errors of exact values."""
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    days = sketches.stored(e, ["day", "event_type"], "user_id", "value", scratch(spark, "sketches"))
    week = F.date_trunc("week", "day").cast("timestamp_ntz").alias("week")
    weeks = sketches.merged(days, [week, F.col("event_type")], 0.5)
    exact = e.groupBy(week, "event_type").agg(F.countDistinct("user_id").alias("users"))
    near = weeks.join(exact, ["week", "event_type"])
    rank = e.select(week, F.col("event_type"), "value").join(weeks.select("week", "event_type", "middle"), ["week", "event_type"])
    rank = rank.groupBy("week", "event_type").agg(F.count(F.when(F.col("value") <= F.col("middle"), 1)).alias("upto"), F.count(F.when(F.col("value") < F.col("middle"), 1)).alias("under"))
    wide = sketches.RANK_ERROR * F.col("n") + 1
    middle = (F.col("under") <= 0.5 * F.col("n") + wide) & (F.col("upto") >= 0.5 * F.col("n") - wide)
    return near.join(rank, ["week", "event_type"]).select("week", "event_type", "n", (F.abs(F.col("about") - F.col("users")) <= sketches.COUNT_ERROR * F.col("users") + 1).alias("users_near"), middle.alias("middle_near"))


@query("SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY event_type")
def source_python(spark: SparkSession, d: str) -> DataFrame:
    """The events through a data source in Python, written by its sink and read again."""
    spark.dataSource.register(ReplaySource)
    path = scratch(spark, "replayed")
    table(spark, d, "events").select("event_type", "ts").write.format(NAME).mode("append").save(path)
    return spark.read.format(NAME).load(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_python(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of a data source in Python, every seventh row a block late, into its own sink; windows over what the sink holds."""
    spark.dataSource.register(ReplaySource)
    path, base = scratch(spark, "events"), scratch(spark, "stream")
    table(spark, d, "events").write.option("maxRecordsPerFile", 100_000).parquet(path)
    own = spark.readStream.format(NAME).option("rows", "997").option("late", "7").load(path).select("event_id", "ts", "event_type")
    out = own.writeStream.format(NAME).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True)
    out.start().awaitTermination()
    return spark.read.format(NAME).load(f"{base}/out").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
