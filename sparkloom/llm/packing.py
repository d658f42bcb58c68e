"""Packing by concatenate and cut.

The first pass tokenises every text, writes the ids once, and numbers them
within its task; the sums of the tasks' tokens, one row for each task, give
every task its place in the one long row of ids.  The second pass cuts that row
every ``length`` ids.  A document that crosses cuts gets one boundary record
for each window it touches.  Only the last window can be short.

Defined cases: null or empty text is the end id alone; a null id and repeated
rows are packed as they come; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, running_offsets, tidy

LENGTH, END_ID = 4096, 2
PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def tokenised(rows: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(part, id, at, n, wide, ids): ids as little-endian integers of 2 bytes (4 if wide), at counts the tokens before in the part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sparkloom.llm.tokens import encoder

        own, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        kind = np.uint16 if own.narrow and end_id < 1 << 16 else np.uint32
        for batch in batches:
            for i, flat, cuts in own.encode(batch.column(1), end_id):
                n = np.diff(cuts)
                data = flat.astype(kind)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int64)), batch.column(0).slice(i, len(n)), pa.array(at + cuts[:-1]), pa.array(n), pa.array(np.full(len(n), kind is np.uint32)), blob],
                    ["part", "id", "at", "n", "wide", "ids"],
                )
                at += int(cuts[-1])
            # or two batches are held while the next one comes
            del batch
        tidy()

    return rows.mapInArrow(encode, "part bigint, id bigint, at bigint, n bigint, wide boolean, ids binary")


def cut(length: int, with_ids: bool):
    """The second pass: rows with their global offset to pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("before").to_numpy() + batch.column("at").to_numpy()
            n = batch.column("n").to_numpy()
            windows = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), windows)
            window = first[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            low = np.maximum(first[row], window * length)
            high = np.minimum(first[row] + n[row], (window + 1) * length)
            start = low - first[row]
            ids, wide = batch.column("ids"), batch.column("wide").to_numpy(zero_copy_only=False)
            crc, blobs, last, data = [], [], -1, b""
            for r, a, b in zip(row.tolist(), start.tolist(), (start + high - low).tolist(), strict=True):
                if r != last:
                    last, data = r, np.frombuffer(ids[r].as_buffer(), np.uint32 if wide[r] else np.uint16).astype("<u4").tobytes()
                crc.append(zlib.crc32(data[4 * a : 4 * b]))
                blobs.append(data[4 * a : 4 * b] if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(high - low), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(window), pa.array(low - window * length), pa.array(blobs, pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece (PIECES); ids are the piece's ids as little-endian 32-bit integers, null unless with_ids."""
    ids = durable(tokenised(id_text(docs, id_col, text_col), end_id, vocabulary), "tokens", "zstd")
    totals = running_offsets(ids.groupBy("part").agg(F.sum("n").alias("n")), "part", "n").select("part", "before")
    # one row for each task of the first pass: its size doesn't depend on the rows
    placed = ids.join(F.broadcast(totals), "part").select("id", "at", "n", "wide", "ids", "before")
    return placed.mapInArrow(cut(length, with_ids), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
