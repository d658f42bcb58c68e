"""Window functions over few, large groups: the order key is range-partitioned, so a group isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import numbered, same, shuffle_partitions, sized
from sparkloom.sources.tables import durable


def ranked(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """df with __rank, __dense, __row (by value, then tie) and __total of each group of ``by``.

    Rows are range-partitioned by (by, value), so equal values lie together and
    only as many rows as share one value must fit a task.  Ranks are taken within
    a partition and group, and the counts of the partitions before, a few rows
    for each partition, are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, by, value).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("__part", by).agg(F.count(F.lit(1)).alias("__rows"), F.countDistinct(F.struct(value)).alias("__values"))
    # one row for each partition and group it holds
    earlier = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("__part"), F.col(by).alias("__by"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__values").over(earlier), F.lit(0)).alias("__values_before"),
        F.sum("__rows").over(Window.partitionBy(by)).alias("__total"),
    )
    local, whole = Window.partitionBy("__part", by).orderBy(value), Window.partitionBy("__part", by).orderBy(value, tie)
    own = placed.withColumns({"__rank": F.rank().over(local), "__dense": F.dense_rank().over(local), "__row": F.row_number().over(whole)})
    own = own.join(counts.withColumnRenamed("__part", "__of"), (F.col("__part") == F.col("__of")) & F.col(by).eqNullSafe(F.col("__by")))
    own = own.withColumns({"__rank": F.col("__rank") + F.col("__rows_before"), "__dense": F.col("__dense") + F.col("__values_before"), "__row": F.col("__row") + F.col("__rows_before")})
    return own.select(*df.columns, *(F.col(c).cast("bigint") for c in ("__rank", "__dense", "__row", "__total")))


def tile(row: Column, total: Column, n: int) -> Column:
    """ntile(n) of a row number: the first total % n tiles have one row more."""
    size, more = F.floor(total / n), total % n
    return F.when(row <= more * (size + 1), F.floor((row - 1) / (size + 1)) + 1).otherwise(more + F.floor((row - 1 - more * (size + 1)) / F.greatest(size, F.lit(1))) + 1).cast("bigint")


def exact_percentiles(df: DataFrame, by: str, value: str, at: dict[str, float], discrete: bool = False) -> DataFrame:
    """(by, one column for each name of at): percentiles by selecting ranks, so no group's values are gathered.

    Continuous ones lie between two neighbouring values; discrete ones are the
    first value whose share of rows reaches the wanted one.  Null values don't count.
    """
    own = df.select(by, value).filter(F.col(value).isNotNull())
    rows = ranked(own, by, value, value)
    out = []
    for name, p in at.items():
        place = (F.lit(p) * (F.col("__total") - 1)) if not discrete else F.greatest(F.ceil(F.lit(p) * F.col("__total")) - 1, F.lit(0))
        low, high = F.floor(place), F.ceil(place)
        here = F.col("__row") - 1
        # of two neighbours each counts by its nearness; if the place is a row, that row alone
        share = F.when(low == high, (here == low).cast("double")).when(here == low, high - place).when(here == high, place - low).otherwise(0.0)
        out.append(F.sum(F.when(share > 0, F.col(value) * share)).alias(name))
    return rows.groupBy(by).agg(*out)


def trailing_count(df: DataFrame, by: str, at: str, seconds: int, name: str) -> DataFrame:
    """df with the number of rows of the same ``by`` in the given seconds up to each row's time, itself included.

    That is the number of rows up to its time less those before the frame, and both are
    running sums over the group's times and their frames' beginnings, in order.  These are
    range-partitioned, summed within partitions, and the sums of the partitions before are
    added; so the work is that of sorting, however many rows a frame has, and no task
    holds a group.  Rows without a time are a frame of their own.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01', cast({at} as timestamp_ntz))")
    own = df.withColumn("__at", micros)
    counts = durable(own.groupBy(by, "__at").agg(F.count(F.lit(1)).alias("__rows")), "counts")
    ends = lambda place, after, rows: F.struct(place.alias("place"), F.lit(after).alias("after"), rows.alias("rows"))
    ends = F.array(ends(F.col("__at"), 1, F.col("__rows")), ends(F.col("__at") - seconds * 1_000_000, 0, F.lit(0).cast("bigint")))
    steps = counts.filter("__at is not null").select(by, "__at", F.explode(ends).alias("__end")).select(by, "__at", "__end.*")
    placed = durable(steps.repartitionByRange(shuffle_partitions(df), by, "place", "after").withColumn("__part", F.spark_partition_id()), "steps")
    # one row for each partition and group it holds
    earlier = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__part", by).agg(F.sum("rows").alias("__sum"))
    before = before.select(F.col("__part").alias("__of"), F.col(by).alias("__by"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", by).orderBy("place", "after").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__sum", F.sum("rows").over(inside)).join(sized(durable(before, "before")), (F.col("__part") == F.col("__of")) & same(by, "__by"))
    sums = F.col("__sum") + F.col("__before")
    found = summed.groupBy(by, "__at").agg(F.sum(F.when(F.col("after") == 1, sums).otherwise(-sums)).alias(name))
    found = found.unionByName(counts.filter("__at is null").withColumnRenamed("__rows", name)).select(F.col(by).alias("__by"), F.col("__at").alias("__time"), name)
    return own.join(found, same(by, "__by") & same("__at", "__time")).select(*df.columns, F.col(name).cast("bigint").alias(name))


def row_frame(df: DataFrame, by: list[str], order: list[Column], preceding: int, following: int, columns: dict[str, Column], rows: int = 100_000) -> DataFrame:
    """df with aggregates over ``preceding`` rows before to ``following`` rows after each row of its group, the row included; groups of any size.

    ``order`` must tell rows apart.  Rows are numbered within their group and fall into
    runs of ``rows``; each run also gets the rows of its neighbours that its own frames
    reach, so a window over runs sees whole frames and no task holds a group.
    """
    if preceding < 0 or following < 0:
        raise ValueError("a frame has the row itself and counts rows from it")
    own = numbered(df, by, order)
    run = lambda x: F.floor(x / rows).cast("bigint")
    # a row is seen by those up to ``following`` before and ``preceding`` after it
    first, last = run(F.greatest(F.col("__row") - following, F.lit(0))), run(F.col("__row") + preceding)
    spread = own.withColumn("__run", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "__run").orderBy("__row").rowsBetween(-preceding, following)
    out = spread.withColumns({name: c.over(w) for name, c in columns.items()})
    return out.filter(F.col("__run") == run(F.col("__row"))).select(*df.columns, *columns)
