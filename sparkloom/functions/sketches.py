"""Sketches kept as columns: distinct counts and quantiles that are merged without the rows they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches, and errors that they keep to: of a distinct count relative to it, of a quantile in its rank.
COUNT_BITS, COUNT_ERROR = 14, 0.04
QUANTILE_K, RANK_ERROR = 800, 0.01


def stored(df: DataFrame, by: list[str], distinct: str, value: str, path: str) -> DataFrame:
    """One row for each group, written to path: n, and sketches of the distinct values of one column and the quantiles of another; nulls don't count."""
    rows = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, COUNT_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("quantile_sketch"),
    )
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def merged(sketches: DataFrame, by: list[Column], quantile: float) -> DataFrame:
    """Groups of stored sketches as one: n, about (distinct values) and middle (the quantile)."""
    whole = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("quantile_sketch").alias("q"))
    names = [c for c in whole.columns if c not in ("n", "d", "q")]
    return whole.select(*names, "n", F.hll_sketch_estimate("d").alias("about"), F.kll_sketch_get_quantile_double("q", F.lit(quantile)).alias("middle"))
