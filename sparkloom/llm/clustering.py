"""Centroid clustering (k-means) of integer vectors with Hamerly's bounds.

Each vector keeps two numbers between rounds: an upper bound of its distance to its own
centroid, and a lower bound of its distance to the second-nearest one.  When centroids
move, the upper bound grows by its own centroid's way and the lower one shrinks by the
longest way of the others.  A vector whose upper bound stays below its lower bound, or
below half the way from its centroid to the nearest other, can't have changed.  Of the
others the upper bound is made exact first, and who is still in doubt is compared with
all centroids in exact integers; of equal distances the smaller number counts.

Bounds are doubles rounded outwards, so they may cost a comparison but never a result.
Vectors with their bounds are written once a round; sums come back as one row for each
centroid and task, and are added in decimals.  The driver holds the centroids only.

Defined cases: only vectors with exactly ``size`` components, none null or non-finite,
are kept; a null id is kept too, but comes last as a first centroid; rows that repeat an
id count each, and the smaller vector comes first as a first centroid; with fewer vectors
than centroids there are as many centroids as vectors; an empty table gives no row.  A
component whose integer lies beyond +-2**27 stops the job, as distances would not fit in
64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, ship, tidy

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LARGEST = 1 << 27
STATE = "id bigint, vector binary, cluster int, upper double, lower double, distance bigint, scanned boolean"
ROWS = 1 << 13


def integers(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, vector): components as little-endian integers of 32 bits; only whole, finite vectors."""
    ship(vectors.sparkSession)
    own = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), own.alias("v")).filter(F.size("v") == size).filter(finite)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size))
            if len(v) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component's integer lies beyond {LARGEST}")
            blob = x.astype("<i4")
            at = np.arange(len(v) + 1, dtype=np.int32) * (4 * size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(blob))])], ["id", "vector"])

    return rows.mapInArrow(floored, "id bigint, vector binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<i4").reshape(-1, size).astype(np.int64) if len(column) and data is not None else np.zeros((0, size), np.int64)


def first_centroids(own: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    # at most k rows
    rows = own.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), "<i4").reshape(-1, size).astype(np.int64)


def up(x: np.ndarray) -> np.ndarray:
    """Square roots of integers, not below the true ones."""
    return np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), np.inf), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    """Square roots of integers, not above the true ones."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), -np.inf), -np.inf), 0.0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def moved(before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each centroid went, how far the farthest other one went, and half the way to its nearest other; rounded so that bounds hold."""
    k = len(now)
    way = up(squared(now, before)) if before is not None else np.full(k, np.inf)
    others = np.array([max([0.0, *np.delete(way, j)]) for j in range(k)])
    apart = down(squared(now[:, None], now[None]))
    np.fill_diagonal(apart, np.inf)
    half = np.nextafter(apart.min(1) / 2, -np.inf) if k else np.zeros(0)
    return way, others, half


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, its squared distance and that of the second-nearest: a full scan in integers."""
    distance = np.stack([squared(x, c) for c in centroids], 1)
    best = distance.argmin(1)
    row = np.arange(len(x))
    least = distance[row, best]
    distance[row, best] = np.iinfo(np.int64).max
    return best, least, distance.min(1)


def assigned(own: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """The vectors with their centroid and bounds (STATE); distances are there in the last assignment."""
    size = centroids.shape[1]
    way, others, half = moved(before, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                x, n = matrix(batch.column("vector"), size), batch.num_rows
                if before is None:
                    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
                else:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    upper = np.nextafter(batch.column("upper").to_numpy() + way[cluster], np.inf)
                    lower = np.nextafter(batch.column("lower").to_numpy() - others[cluster], -np.inf)
                distance = squared(x, centroids[cluster]) if last and before is not None else None
                doubtful = np.flatnonzero(~(upper < np.maximum(lower, half[cluster])))
                if before is not None and len(doubtful):
                    mine = cluster[doubtful]
                    upper[doubtful] = up(distance[doubtful] if last else squared(x[doubtful], centroids[mine]))
                    doubtful = doubtful[~(upper[doubtful] < np.maximum(lower[doubtful], half[mine]))]
                if len(doubtful):
                    best, least, second = nearest(x[doubtful], centroids)
                    cluster[doubtful], upper[doubtful], lower[doubtful] = best, up(least), down(second)
                    if distance is not None:
                        distance[doubtful] = least
                if last and distance is None:
                    distance = squared(x, centroids[cluster])
                scanned = np.zeros(n, bool)
                scanned[doubtful] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance) if last else pa.nulls(n, pa.int64()), pa.array(scanned)],
                    [c.split()[0] for c in STATE.split(", ")],
                )
        tidy()

    return own.mapInArrow(assign, STATE)


def sums_of(state: DataFrame, k: int, size: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors, their number and their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                x, cluster = matrix(batch.column("vector"), size), batch.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.select("vector", "cluster").mapInArrow(add, "cluster int, n bigint, total array<bigint>")
    # one row for each centroid
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")) for j in range(size))).alias("total"))
    return {r["cluster"]: (r["n"], [int(x) for x in r["total"]]) for r in wide.collect()}


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in centroid.tolist()).encode()).hexdigest()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid (array of bigint), scanned (whether the last assignment compared it with all centroids)."""
    spark = vectors.sparkSession
    own = durable(integers(vectors, id_col, vector_col, size, scale), "vectors", "zstd")
    now, before = first_centroids(own, k, seed, size), None
    k = len(now)
    state = own
    for _ in range(rounds if k else 0):
        state = durable(assigned(state, now, before, False), "assigned", "zstd")
        sums = sums_of(state, k, size)
        before, now = now, np.array([[x // sums[j][0] for x in sums[j][1]] if j in sums else now[j] for j in range(k)], np.int64).reshape(k, size)
    if not k:
        now = np.zeros((0, size), np.int64)
        state = durable(own.limit(0).select("id", "vector", F.lit(0).alias("cluster"), *(F.lit(0.0).alias(c) for c in ("upper", "lower")), F.lit(0).cast("bigint").alias("distance"), F.lit(False).alias("scanned")), "assigned")
    else:
        state = durable(assigned(state, now, before, True), "assigned", "zstd")
    # one row for each centroid
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(j, inertia[j], sum(inertia.values()), digest(now[j]), now[j].tolist()) for j in sorted(inertia)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return state.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid", "scanned")


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.drop("centroid", "scanned").withColumnRenamed("id", "vec_id")


def _oracle() -> str:
    parts = [
        f"""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM e QUALIFY c < {CENTROIDS})""",
    ]
    nearest = """SELECT vec_id, r, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
SELECT e.vec_id, e.r, e.v, c.c, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM (SELECT *, row_number() OVER () AS r FROM e) e, c{i} c) GROUP BY vec_id, r, v"""
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.replace('{i}', str(i))})")
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT c, unnest(v) AS x, unnest(range({SIZE})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c
UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.c = c.c"""


QUERIES = {"op13_hamerly": op13_hamerly}
ORACLES = {"op13_hamerly": _oracle()}
