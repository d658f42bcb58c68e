"""Exact deduplication by a distributed content sort; DataFrame functions only.

1. A bounded sample of (first 48 characters, hash, lot) of the normalised texts
   gives at most SPLITTERS splitters.  The lot is a hash of the row's place in its
   task, so a group of copies of any size is cut into several ranges, even if its
   rows have one id or none.
2. Each row finds its range by binary search.  Where more ranges are wanted than
   there are splitters, a range is cut again by the hash, and rows that agree with
   a splitter, whose group may be of any size, by the lot.  One shuffle sends each
   row to its range.
3. Spark's external sort orders a range by (first characters, hash, text, id),
   so equal texts are neighbours; ``lag`` compares each full text with the one
   before it.
4. A run can go on in another range only if it has the first characters and
   the hash of a splitter.  Of such runs, the first row keeps its text; they
   are compared in full and joined.

Defined cases: null text is empty; a null id sorts last and its row is kept only
if no row of the group has an id (keep_id is then null); of rows that repeat an
id and a text one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, partitions, sized

SAMPLES_PER_RANGE, SPLITTERS = 24, 1024
PREFIX = 48


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def lot():
    """A number that parts rows which agree in all columns; it decides where rows are compared, not with which result."""
    return F.xxhash64(F.monotonically_increasing_id())


def splitters(rows: DataFrame, ranges: int) -> list[tuple[str, int, int]]:
    """At most ranges - 1 keys that cut the rows into even runs, from a sample of SAMPLES_PER_RANGE * ranges rows."""
    n = rows.count()
    if not n or ranges < 2:
        return []
    some = rows.sample(min(1.0, SAMPLES_PER_RANGE * ranges / n), 17) if n > SAMPLES_PER_RANGE * ranges else rows
    norm = normalised(F.col("text"))
    keys = sorted(
        ((p, h, i) for p, h, i in some.select(F.substring(norm, 1, PREFIX), F.xxhash64(norm), lot()).collect()),
        key=lambda k: (k[0].encode(), k[1], k[2]),
    )
    return sorted({keys[len(keys) * j // ranges] for j in range(1, ranges)}, key=lambda k: (k[0].encode(), k[1], k[2])) if keys else []


def range_of(cuts: list[tuple[str, int, int]]) -> Column:
    """How many splitters are at or below the row's key (prefix, hash, key): a binary search."""
    if not cuts:
        return F.lit(0)
    p, h, i = (F.lit([c[j] for c in cuts]) for j in range(3))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        own = lambda a: F.get(a, at - 1)  # noqa: E731  null beyond the last splitter, and so not at or below
        below = (own(p) < F.col("prefix")) | ((own(p) == F.col("prefix")) & ((own(h) < F.col("hash")) | ((own(h) == F.col("hash")) & (own(i) <= F.col("key")))))
        return F.when(below, at).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, splits: int = SPLITTERS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    wanted = ranges or 4 * partitions(spark)
    ranges = min(wanted, splits)
    finer = -(-wanted // ranges)
    cuts = splitters(rows, ranges)
    keyed = rows.select("id", lot().alias("key"), normalised(F.col("text")).alias("norm"))
    keyed = keyed.withColumns({"prefix": F.substring("norm", 1, PREFIX), "hash": F.xxhash64("norm")})
    keyed = keyed.withColumn("range", range_of(cuts))
    if cuts:
        near = lambda j: (F.get(F.lit([c[0] for c in cuts]), j) == F.col("prefix")) & (F.get(F.lit([c[1] for c in cuts]), j) == F.col("hash"))
        edge = F.coalesce(near(F.col("range") - 1), F.lit(False)) | F.coalesce(near(F.col("range")), F.lit(False))
    else:
        edge = F.lit(False)
    keyed = keyed.withColumn("edge", edge)
    if finer > 1:
        again = F.pmod(F.when(F.col("edge"), F.xxhash64("key")).otherwise(F.xxhash64("hash")), F.lit(finer))
        keyed = keyed.withColumn("range", F.col("range") * finer + again)
    last = F.asc_nulls_last("id")
    inside = Window.partitionBy("range").orderBy("prefix", "hash", "norm", last)
    runs = keyed.withColumn("first", F.coalesce(F.lag("norm").over(inside) != F.col("norm"), F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("first").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select("id", "range", "run", "edge", F.sha2("norm", 256).alias("sha"), F.when(F.col("edge") & F.col("first"), F.col("norm")).alias("edge_text"))
    own = Window.partitionBy("range", "run")
    slim = durable(
        runs.select(
            "id", "range", "run", "edge", "sha", "edge_text",
            F.min("id").over(own).alias("low"),
            F.count(F.lit(1)).over(own).alias("n"),
            F.row_number().over(own.orderBy(last)).alias("place"),
        ),
        "dedup-runs",
    )
    # runs at splitters: at most a few for each splitter, whatever the number of rows
    at_edge = slim.filter("edge and edge_text is not null")
    whole = at_edge.groupBy("edge_text").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "range", "run")).alias("best"), F.sum("n").alias("all_n"))
    joined = at_edge.join(whole, "edge_text").select(
        "range", "run", F.col("best.low").alias("all_low"), F.col("all_n"),
        ((F.col("best.range") == F.col("range")) & (F.col("best.run") == F.col("run"))).alias("best_run"),
    )
    inner = slim.filter("not edge").select("id", "low", "n", (F.col("place") == 1).alias("kept"), "sha")
    outer = slim.filter("edge").join(joined, ["range", "run"]).select("id", F.col("all_low").alias("low"), F.col("all_n").alias("n"), (F.col("best_run") & (F.col("place") == 1)).alias("kept"), "sha")
    return inner.union(outer).select("id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; same columns."""
    found = dedup_groups(docs, id_col, text_col)
    # only rows that go are joined: by broadcast while there are few, else by a shuffle
    gone = durable(found.filter("not kept").select(F.col("id").alias("__gone"), F.col("text_sha256").alias("__sha"), F.col("keep_id").eqNullSafe(F.col("id")).alias("__again")), "gone")
    own = (F.col(id_col).cast("bigint").eqNullSafe(F.col("__gone"))) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("__sha"))
    gone = sized(gone)
    out = docs.join(gone.filter("not __again"), own, "left_anti")
    # rows that repeat an id and a text: one of them stays
    again = gone.filter("__again").select("__gone", "__sha").distinct()
    if again.limit(1).count():
        once = out.join(again, own, "left_semi").withColumn("__norm_sha", F.sha2(normalised(F.col(text_col)), 256)).dropDuplicates([id_col, "__norm_sha"]).drop("__norm_sha")
        out = out.join(again, own, "left_anti").union(once)
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": ORACLE}
