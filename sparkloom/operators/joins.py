"""Joins beyond equality: as-of, range, and skew-resistant equi joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import cell_join, same, shuffle_partitions, sized
from sparkloom.sources.tables import durable


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], tolerance: str | None = None) -> DataFrame:
    """Each left row with the last right row of the same ``by`` whose ``on`` isn't later; unmatched left rows have nulls.

    Both sides are put in one sorted stream per key and the right side's last
    row is carried on by a window, so nothing is multiplied and one shuffle on
    the keys is enough.  Of right rows with equal ``on``, the largest by the
    taken columns is used.  ``tolerance`` is an interval, such as '1 hour'.
    """
    packed = F.struct(F.col(on).alias("__at"), *(F.col(c).alias(c) for c in take))
    nothing = F.lit(None)
    marked = left.withColumns({"__side": F.lit(1), "__row": nothing})
    kind = right.select(packed.alias("p")).schema["p"].dataType
    marked = marked.withColumn("__row", F.lit(None).cast(kind))
    rights = right.select(*[F.col(c) for c in by], F.col(on), F.lit(0).alias("__side"), packed.alias("__row"))
    both = marked.unionByName(rights, allowMissingColumns=True)
    # equal times: right rows first
    w = Window.partitionBy(*by).orderBy(F.col(on), F.col("__side"), F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__row", ignorenulls=True).over(w)).filter("__side = 1")
    if tolerance is not None:
        out = out.withColumn("__last", F.when(F.col("__last.__at") >= F.col(on) - F.expr(f"interval {tolerance}"), F.col("__last")))
    return out.select(*left.columns, *(F.col(f"__last.{c}").alias(c) for c in take))


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, cell: int = 4096) -> DataFrame:
    """Pairs with low <= value < high.

    Values fall into bins of the given width and intervals into all bins they
    touch, which makes it an equi join with a residual filter; width should be
    about the usual length of an interval.  A bin with many rows is cut into cells, and
    there are as many tasks as the pairs ask for.
    """
    a = left.withColumn("__bin", F.floor(F.col(value) / width))
    b = right.filter(f"{low} < {high}").withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return cell_join(a, b, ["__bin"], cell).filter((F.col(low) <= F.col(value)) & (F.col(value) < F.col(high))).drop("__bin")


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int) -> DataFrame:
    """Equi join that deals the hot keys of the large side over ``salts`` tasks and repeats their rows of the small side as often.

    A key is hot if it has more rows than a shuffle partition has on average; of
    such keys there are fewer than partitions, so they can be broadcast.
    """
    counts = large.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    n = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(counts.filter(F.col("__n") * n > total).select(on, F.lit(salts).alias("__salts")))
    turn = F.coalesce("__salts", F.lit(1))
    a = large.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*large.columns), turn)).drop("__salts")
    b = small.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), turn - 1).cast("array<bigint>"))).drop("__salts")
    return a.join(b, [on, "__salt"]).drop("__salt")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark turns the rank filter into a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def asof_ranged(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], tolerance: str | None = None) -> DataFrame:
    """As asof_backward, for keys of any size, or none at all (``by`` empty): the stream is range-partitioned by key and time.

    Within a partition the last right row is carried on by a window.  What a partition's
    first key has at its beginning comes from the partitions before: each hands on its
    last right row of each key that goes on, at most two rows for each partition, and a
    window over these finds the last one that isn't null.  Null keys are a key like
    others, rows without a time match nothing.
    """
    packed = F.struct(F.col(on).alias("__at"), *(F.col(c).alias(c) for c in take))
    kind = right.select(packed.alias("p")).schema["p"].dataType
    marked = left.withColumns({"__side": F.lit(1), "__last": F.lit(None).cast(kind)})
    rights = right.filter(F.col(on).isNotNull()).select(*by, on, F.lit(0).alias("__side"), packed.alias("__last"))
    both = marked.unionByName(rights, allowMissingColumns=True).withColumn("__tie", F.monotonically_increasing_id())
    order = [on, "__side", "__last", "__tie"]
    # __tie parts rows of one time; the order of right rows of one time is that of what is taken
    n = shuffle_partitions(left)
    placed = durable(both.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "asof")
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("__found", F.last("__last", ignorenulls=True).over(inside))
    ends = placed.groupBy("__part", *by).agg(F.max(F.when(F.col("__last").isNotNull(), F.struct(F.col(on).alias("at"), F.col("__last").alias("row")))).getField("row").alias("__end"))
    groups = Window.partitionBy(*by)
    carried = ends.withColumn("__parts", F.count(F.lit(1)).over(groups)).filter("__parts > 1")
    earlier = groups.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).filter("__carried is not null")
    # a key in several partitions is the first or last one of each
    carried = durable(carried.select(F.col("__part").alias("__of"), *(F.col(c).alias(f"__by_{c}") for c in by), "__carried"), "carried")
    same_group = reduce(and_, [same(c, f"__by_{c}") for c in by], F.col("__part") == F.col("__of"))
    out = found.filter("__side = 1").join(sized(carried), same_group, "left")
    out = out.withColumn("__best", F.when(F.col(on).isNotNull(), F.coalesce("__found", "__carried")))
    if tolerance is not None:
        out = out.withColumn("__best", F.when(F.col("__best.__at") >= F.col(on) - F.expr(f"interval {tolerance}"), F.col("__best")))
    return out.select(*left.columns, *(F.col(f"__best.{c}").alias(c) for c in take))
