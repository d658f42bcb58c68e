"""Similarities of a query set with all rows, in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordering import shuffle_partitions

#: Rows of a tile, and tiles of a task where there are more tiles than tasks.
STRIPE, TILES = 4096, 4


def cosines(rows: DataFrame, asked: DataFrame, key: str, vector: str, queries: int, stripe: int = STRIPE) -> DataFrame:
    """(key, query_id, cosine to four digits) of each row with each asked row.

    Rows are dealt to stripes and queries to blocks of about ``queries``; each pair of a
    stripe and a block is a group, whose cosines are one product of matrices, so a task
    holds ``stripe`` x ``queries`` numbers at once.  A vector of length 0 has the cosine nan; vectors
    that are null, hold nulls or differ in size have null.
    """
    blocks, stripes = max(1, -(-asked.count() // queries)), max(1, -(-rows.count() // stripe))
    tasks = max(shuffle_partitions(rows), blocks * stripes // TILES)
    number = lambda n: F.pmod(F.xxhash64(key, vector), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    where = ["__block", "__stripe"]
    a = rows.select(key, vector, number(stripes).alias("__stripe")).withColumn("__block", every(blocks)).repartition(tasks, *where)
    # columns of their own: those that a cogroup has from both sides are pruned on one when its result is only counted
    b = asked.select(F.col(key).alias("__id"), F.col(vector).alias("__vector"), number(blocks).alias("__block")).withColumn("__stripe", every(stripes)).repartition(tasks, *where)

    def tile(left, right):
        import numpy as np
        import pyarrow as pa

        def by_size(t, vector):
            """Places and matrix of the vectors of each size; those with nulls have none."""
            held = t.column(vector).combine_chunks()
            sizes = np.array(held.value_lengths().fill_null(-1))
            nulls = np.array(held.flatten().is_null())
            if nulls.any():
                sizes[np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))[nulls]] = -1
            own = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist() if n >= 0}
            return {n: (i, np.array(held.take(pa.array(i)).flatten(), dtype=float).reshape(len(i), n)) for n, i in own.items()}

        if not len(left) or not len(right):  # a side without rows has no columns
            ids = pa.array([], left.schema.field(key).type if len(left) else right.schema.field("__id").type)
            return pa.Table.from_arrays([ids, ids, pa.array([], pa.float64())], [key, "query_id", "cosine"])
        found, known = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), bool)
        mine, theirs = by_size(left, vector), by_size(right, "__vector")
        with np.errstate(all="ignore"):
            for n in mine.keys() & theirs.keys():
                (i, x), (j, y) = mine[n], theirs[n]
                c = x @ y.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))
                # halves are rounded away from 0, and there is no -0
                z = c * 1e4
                whole = np.trunc(z)
                found[np.ix_(i, j)] = (whole + np.sign(z) * (np.abs(z - whole) >= 0.5)) / 1e4 + 0.0
                known[np.ix_(i, j)] = True
        ids = [np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left))]
        ids = [c.combine_chunks().take(pa.array(k)) for c, k in zip((left.column(key), right.column("__id")), ids, strict=True)]
        return pa.Table.from_arrays([*ids, pa.array(found.ravel(), mask=None if known.all() else ~known.ravel())], [key, "query_id", "cosine"])

    kind = dict(rows.dtypes)[key]
    return a.groupBy(*where).cogroup(b.groupBy(*where)).applyInArrow(tile, f"{key} {kind}, query_id {kind}, cosine double")
