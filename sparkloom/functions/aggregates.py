"""Aggregates in Python by two phases: partial states in each task, before the shuffle, and their merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose states a task holds at once.
STATES = 100_000


def two_phases(df: DataFrame, by: str, value: str, state: dict[str, str], partial: Callable, result: dict[str, Column], states: int = STATES) -> DataFrame:
    """(by, result): partial(values) gives one tuple of numbers (the columns ``state``) for the values of a key, a numpy array.

    A task adds up its batches' states of a key, so what is shuffled is a row for each task
    and key, and no group is gathered.  How states add up is in their names, which begin
    with sum_, min_ or max_.  ``result`` holds columns made of the merged states.  Null
    values are left out, null keys form a group, and a key without values has null states.
    """
    kinds = {name: name.split("_")[0] for name in state}
    if not set(kinds.values()) <= {"sum", "min", "max"}:
        raise ValueError("state columns begin with sum_, min_ or max_")
    key_type = dict(df.dtypes)[by]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        join = {"sum": lambda a, b: a + b, "min": min, "max": max}
        held: dict = {}

        def rows() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([None if held[k] is None else held[k][j] for k in keys], pa.float64() if t == "double" else pa.int64()) for j, t in enumerate(state.values())]
            return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *columns], [by, *state])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            values = batch.column(1)
            there = values.is_valid().to_numpy(zero_copy_only=False)
            numbers = values.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            found, start = np.unique(codes[order], return_index=True)
            names = [*keys.dictionary.to_pylist(), None]
            for code, rows_of in zip(found.tolist(), np.split(order, start[1:]), strict=True):
                some = numbers[rows_of[there[rows_of]]]
                key = names[code]
                own = tuple(x.item() if hasattr(x, "item") else x for x in partial(some)) if len(some) else None
                old = held.get(key)
                held[key] = own if old is None else old if own is None else tuple(join[k](a, b) for k, a, b in zip(kinds.values(), old, own, strict=True))
            if len(held) > states:
                yield rows()
                held.clear()
        if held:
            yield rows()

    parts = df.select(by, value).mapInArrow(add, f"{by} {key_type}, " + ", ".join(f"{n} {t}" for n, t in state.items()))
    merged = parts.groupBy(by).agg(*(getattr(F, k)(n).alias(n) for n, k in kinds.items()))
    return merged.select(by, *(c.alias(n) for n, c in result.items()))


def geometric_means(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, name): the geometric mean of each key's positive values; 0 if there are none."""

    def partial(x):
        import numpy as np

        own = x[x > 0]
        return len(own), float(np.log(own).sum())

    mean = F.when(F.col("sum_n") > 0, F.exp(F.col("sum_logs") / F.col("sum_n"))).otherwise(0.0)
    return two_phases(df, by, value, {"sum_n": "bigint", "sum_logs": "double"}, partial, {name: mean})
