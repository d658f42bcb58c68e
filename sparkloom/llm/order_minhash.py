"""Order MinHash fingerprints of whole texts.

A text's k-mers are its runs of K code points, each numbered by its occurrence
in the text.  For each of SKETCHES orders (32-bit multiplicative hashes of the
numbered k-mer, ties by place), the TUPLE smallest are taken, put back into text order, and
their k-mers hashed together.  Two fingerprints are alike by the share of equal
parts; as the order within a tuple counts, moving text lowers it as edits do.

Defined cases: null text is empty; a text shorter than K is one k-mer; a text
with fewer than TUPLE k-mers gives shorter tuples; the empty text has the empty
fingerprint, which is like itself (1.0) and nothing else (0.0).

The query compares each document with the next one by descending id (nulls
last, ties by the text's hash).  Texts move once, in a range partitioning;
a partition's last document meets the first of the next one in a second step
over one pair for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, partitions
from sparkloom.llm.shingles import mix, powers, stream

K, SKETCHES, TUPLE = 10, 64, 2
_U = np.uint64


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of code points (of the whole, if it is shorter)."""
    n = len(points)
    if n <= k:
        k = n
    up, down = powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum((points.astype(_U) + _U(1)) * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + _U(k))


def numbered(own: np.ndarray) -> np.ndarray:
    """The occurrence number of each k-mer: how many equal ones stand before it."""
    n = len(own)
    places = np.argsort(own, kind="stable")
    heads = own[places]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(heads[1:], heads[:-1], out=fresh[1:])
    rank = np.arange(n)
    start = np.where(fresh, rank, 0)
    out = np.empty(n, np.int64)
    out[places] = rank - np.maximum.accumulate(start)
    return out


@cache
def _seeds(sketches: int, tuple_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each order's multiplier, each place's multiplier in a tuple, and each order's own number."""
    orders = stream(sketches, 8) | _U(1)
    return orders.astype(np.uint32), stream(tuple_size, 9) | _U(1), orders


def sketch(text: str, k: int = K, sketches: int = SKETCHES, tuple_size: int = TUPLE) -> np.ndarray:
    """32-bit parts of the fingerprint; none for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32)
    own = kmers(points, k)
    n = len(own)
    base = (mix(own + numbered(own).astype(_U) * _U(0xC2B2AE3D27D4EB4F)) >> _U(32)).astype(np.uint32)
    size = min(tuple_size, n)
    orders, places, salts = _seeds(sketches, tuple_size)
    best = np.empty((sketches, size), np.int64)
    step = max(1, (1 << 18) // n)
    # few values are below the limit, and nearly always enough
    limit = np.uint32(min(2.0**32 - 1, 6.0 * size / n * 2.0**32))
    for a in range(0, sketches, step):
        values = base[None, :] * orders[a : a + step, None]
        at = np.flatnonzero(values.ravel() < limit)
        row = at // n
        enough = np.bincount(row, minlength=len(values)) >= size
        # by row, then value, then place in the text
        order = np.argsort(row.astype(_U) << _U(32) | values.ravel()[at], kind="stable")
        row, col = row[order], (at - row * n)[order]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < size) & enough[row]
        best[a : a + len(values)][enough] = col[keep].reshape(-1, size)
        for r in np.flatnonzero(~enough):
            best[a + r] = np.argsort(values[r], kind="stable")[:size]
    best.sort(axis=1)
    parts = (own[best] * places[:size]).sum(axis=1, dtype=_U)
    return (mix(parts + salts) >> _U(32)).astype(np.uint32)


def as_text(parts: np.ndarray) -> str:
    return parts.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b) or not len(a):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def compared(i: int | None, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = sketch(changed)
    return (i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, after_own))


def _batch(rows: list[tuple], more: dict[str, list] | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _NAMES) if more is None else pa.RecordBatch.from_arrays([*columns, *more.values()], [*_NAMES, *more])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to the next document (RESULT)."""
    rows = id_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    keys = [F.desc_nulls_last("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0 are results; kind 1 is the partition's first text, kind 2 its last."""
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def made(rows: list[tuple], kind: int, texts: list) -> pa.RecordBatch:
            m = len(rows)
            return _batch(rows, {"part": pa.array([part] * m, pa.int64()), "kind": pa.array([kind] * m, pa.int32()), "text": pa.array(texts, pa.string())})

        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                own = sketch(text)
                if last is None:
                    yield made([(i, 0, None, None, None, None, None)], 1, [text])
                else:
                    out.append(compared(*last, text, own))
                last = (i, text, own)
            if out:
                yield made(out, 0, [None] * len(out))
        if last is not None:
            yield made([(last[0], 0, None, None, None, None, None)], 2, [last[1]])

    found = durable(ordered.mapInArrow(walk, f"{RESULT}, part bigint, kind int, text string"), "fingerprints", "zstd")
    # one first and one last text for each partition; the last one is followed by the very first
    ends = found.filter("kind > 0")
    heads = ends.filter("kind = 1").select("part", F.col("text").alias("after"))
    steps = ends.filter("kind = 1").select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    steps = steps.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy(F.lit(1)))))
    tails = ends.filter("kind = 2").select("part", "id", "text").join(F.broadcast(steps), "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next"), "next").select("id", "text", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([compared(i, t, sketch(t), a, sketch(a)) for i, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return found.filter("kind = 0").select(*_NAMES).union(pairs.mapInArrow(finish, RESULT))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_order_minhash": op8_order_minhash}
ORACLES: dict[str, str] = {}
