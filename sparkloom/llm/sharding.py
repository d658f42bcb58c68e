"""Sharding along a Hilbert curve, law ``rows``: shards' counts differ by one at most.

Language, source and size are quantised to BITS bits each; the Hilbert index of
that cell orders the documents, so that a shard holds few values of each and a
reader can skip shards by their ranges.  A category's cell is its place among the
shares of all rows, the most frequent first, so that cells are about evenly
filled; those beyond the first CATEGORIES share what is left by hash.  Equal
texts form a group, which takes the cell of its smallest id and stays in one
shard.

1. Rows are range-partitioned and sorted by (index, text hash, id) and get their
   place in the whole order by prefix sums over the partitions' counts.
2. A group of several rows belongs to the shard in which its middle lies.  If
   the groups of a shard don't fit, those of the largest size classes (powers of
   two) are taken apart, which is the case for a group larger than a shard.
3. All other rows fill what is left of the shards in curve order.

Rows meet their groups by broadcast while groups of several rows are few; beyond
that groups of more than a HEAVY-th of all rows, of which there are fewer than
HEAVY, still do, and only the others' rows are shuffled by the text's hash.
Only ids, sizes, hashes and indexes are shuffled, never texts.

Defined cases: null text is empty (size 1); null language or source is the empty
string; null ids sort last; repeated rows are rows of one group; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import BROADCAST_ROWS, documents, durable, id_key, partitions, running_offsets, ship, sized

SHARDS, BITS, CATEGORIES, HEAVY = 16, 5, 256, 1000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of cells (rows of d coordinates below 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in reversed(range(bits)):
        for i in range(d):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _category(docs: DataFrame, name: str) -> Column:
    """BITS bits of a category: its place among the shares of all rows."""
    own = F.coalesce(F.col(name).cast("string"), F.lit(""))
    counts = docs.groupBy(own.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # at most CATEGORIES rows, each with the number of all rows
    every = counts.agg(F.sum("n")).first()[0] or 0
    known, before = [], 0
    for value, n in counts.orderBy(F.desc("n"), "value").limit(CATEGORIES).collect():
        known.append((value, before * (1 << BITS) // every))
        before += n
    rest = F.lit(before / max(1, every)) + F.lit(1 - before / max(1, every)) * F.pmod(F.xxhash64(own), F.lit(1 << 20)) / F.lit(float(1 << 20))
    cell = F.least(F.floor(rest * (1 << BITS)).cast("int"), F.lit((1 << BITS) - 1))
    if not known:
        return cell
    at = F.array_position(F.lit([v for v, _ in known]), own)
    return F.when(at > 0, F.get(F.lit([c for _, c in known]), at.cast("int") - 1)).otherwise(cell)


def with_groups(rows: DataFrame, groups: DataFrame, total: int, columns: list[str]) -> DataFrame:
    """rows (hash, ...) with the columns of their group (hash, n, ...), null for rows that have none; groups of one row aren't in groups."""
    own = groups.select("hash", *columns)
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(own), "hash", "left")
    heavy = F.broadcast(groups.filter(F.col("n") * HEAVY > total).select("hash", *columns))
    light = rows.join(heavy.select("hash"), "hash", "left_anti").join(own, "hash", "left")
    return light.unionByName(rows.join(heavy, "hash").select(*light.columns))


def _magnitude(c: Column) -> Column:
    """The number of binary digits, below 2**BITS."""
    return F.least(F.length(F.bin(c)), F.lit((1 << BITS) - 1))


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs."""
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("bigint")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(cells.to_numpy(np.int64), BITS))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("hash"),
        F.struct(*(_category(docs, c).cast("int").alias(f"c{j}") for j, c in enumerate(by)), _magnitude(F.octet_length(text) + 1).alias("c")).alias("cell"),
    )
    rows = durable(rows.select("id", "size", "text_crc32", "hash", index("cell").alias("own")), "cells")
    total = rows.count()
    groups = rows.groupBy("hash").agg(F.min(F.struct(F.col("id").isNull(), "id", "own")).getField("own").alias("curve"), F.count(F.lit(1)).alias("n"))
    groups = durable(groups.filter("n > 1"), "groups")
    order = ["curve", "hash", "key"]
    full = with_groups(rows, groups, total, ["curve", "n"])
    full = full.select("id", id_key().alias("key"), "size", "text_crc32", "hash", F.coalesce("curve", "own").alias("curve"), F.coalesce("n", F.lit(1)).alias("n"))
    place = F.monotonically_increasing_id()
    ordered = full.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ordered = ordered.select("id", "size", "text_crc32", "hash", "n", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("local"))
    ordered = durable(ordered, "curve")

    counts = running_offsets(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part", "rows")
    q, r = divmod(total, n)
    sizes = [q + (s < r) for s in range(n)]
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()

    def slot_of(place: Column, starts: list[int]) -> Column:
        """The shard whose range of places, from starts[s] to starts[s + 1], holds the place."""
        return F.size(F.filter(F.lit(starts[1:]), lambda end: end <= place))

    # one row for each partition
    placed = ordered.join(F.broadcast(counts.select("part", "before")), "part").withColumn("place", F.col("before") + F.col("local")).drop("before")
    several = placed.filter("n > 1").groupBy("hash", "n").agg(F.min("place").alias("first"))
    several = several.select("hash", "n", slot_of(F.col("first") + F.expr("n div 2"), starts).alias("home"), F.length(F.bin("n")).alias("class"))
    # n shards times at most 63 size classes
    classes = several.groupBy("home", "class").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("home").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    fits = sorted(tuple(x) for x in classes.withColumn("upto", F.sum("rows").over(upto)).collect())
    kept = {(home, c): rows for home, c, rows, upto in fits if upto <= sizes[home]}
    whole = several.filter(F.concat_ws(":", "home", "class").isin([f"{h}:{c}" for h, c in kept])).select("hash", "n", "home")
    whole = durable(whole, "whole")
    free = [sizes[s] - sum(rows for (home, _), rows in kept.items() if home == s) for s in range(n)]
    free_starts = np.concatenate([[0], np.cumsum(free)]).tolist()

    marked = durable(with_groups(placed.drop("n"), whole, total, ["home"]).select("id", "size", "text_crc32", "part", "local", "home"), "marked")
    within = Window.partitionBy("part").orderBy("local").rowsBetween(Window.unboundedPreceding, -1)
    loose = running_offsets(marked.groupBy("part").agg(F.count(F.when(F.col("home").isNull(), 1)).alias("rows")), "part", "rows")
    turn = F.col("before") + F.coalesce(F.sum(F.col("home").isNull().cast("int")).over(within), F.lit(0))
    dealt = marked.join(F.broadcast(loose.select("part", "before")), "part").withColumn("shard", F.coalesce("home", slot_of(turn, free_starts))).drop("before", "home")
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", "shard").orderBy("local")))
    dealt = durable(dealt, "dealt")
    parts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("part", "shard", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # at most n rows for each partition: counted, as there can be many of both
    return dealt.join(sized(durable(parts, "parts")), ["part", "shard"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_hilbert_shards": op9_hilbert_shards}
ORACLES: dict[str, str] = {}
