"""Sequences of events: one step after another, within a time, without a certain event between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_sequences(df: DataFrame, by: list[str], at: str, id_col: str, steps: dict[str, Column], never: Column, seconds: int) -> DataFrame:
    """(by, one id for each step): each row of the last step with the latest row of the step before it, and so on back to the first.

    ``never`` ends all sequences that are under way.  A sequence counts if its last row is
    at most ``seconds`` after its first.  Rows of one time are in the order of their ids.

    The state of each step, the latest sequence that reached it, is carried on by a window;
    all steps use one order, and so one sort.  Time is cut into spans of that length; a
    row is in its own span and the next, so the rows of a key are split by time, and a
    sequence that counts never needs more than two spans.
    """
    if len(steps) < 2:
        raise ValueError("a sequence has two steps at least")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz"))
    names, hits = list(steps), list(steps.values())
    rows = df.select(*by, F.col(id_col).alias("__id"), micros.alias("__at"), *(F.coalesce(h, F.lit(False)).alias(f"__hit{k}") for k, h in enumerate(hits)), F.coalesce(never, F.lit(False)).alias("__never"))
    rows = rows.filter(F.col("__at").isNotNull())
    # rows that are neither a step nor an end have no part in it
    rows = rows.filter(" or ".join(["__never", *(f"__hit{k}" for k in range(len(hits)))]))
    rows = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("__span", F.floor(F.col("__at") / (seconds * 1_000_000)).cast("bigint") + F.when(F.col("__own"), 0).otherwise(1))
    w = Window.partitionBy(*by, "__span").orderBy("__at", "__id").rowsBetween(Window.unboundedPreceding, -1)
    kind = "struct<first:bigint,ids:array<{}>>".format(dict(df.dtypes)[id_col])
    ended = F.struct(F.lit(None).cast("bigint").alias("first"), F.lit(None).alias("ids")).cast(kind)
    for k in range(len(hits) - 1):
        if k:
            goes_on = F.col(f"__hit{k}") & ~F.col("__never") & F.col(f"__state{k - 1}.first").isNotNull()
            own = F.struct(F.col(f"__state{k - 1}.first").alias("first"), F.concat(f"__state{k - 1}.ids", F.array("__id")).alias("ids"))
        else:
            goes_on, own = F.col("__hit0"), F.struct(F.col("__at").alias("first"), F.array("__id").alias("ids"))
        change = F.when(goes_on, own.cast(kind)).when(F.col("__never"), ended)
        rows = rows.withColumn(f"__state{k}", F.last(change, ignorenulls=True).over(w))
    last = F.col(f"__state{len(hits) - 2}")
    found = rows.filter(F.col("__own") & F.col(f"__hit{len(hits) - 1}") & ~F.col("__never") & last["first"].isNotNull() & (F.col("__at") - last["first"] <= seconds * 1_000_000))
    return found.select(*by, *(last["ids"][k].alias(n) for k, n in enumerate(names[:-1])), F.col("__id").alias(names[-1]))
