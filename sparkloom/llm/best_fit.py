"""Best-fit packing by minimum bin slack.

Texts are tokenised and cut into pieces of at most ``length`` ids; only longer
documents are cut.  How many pieces there are of each length is all that decides
which lengths go together, and there are at most ``length`` lengths, so this table
has a fixed size, however many documents there are.

A bin takes the longest piece left.  Subset sums over the other lengths left, longest
first, as bits of one integer, tell the fullest sum that fits; the lengths that form it
are found by going back through the steps, and the bin is removed.  The next bin would
be the same as long as enough pieces of its lengths are left, so it is made as often as
that at once.  Each time some length runs short, so there are at most about
``length * log(length)`` kinds of bins.

Pieces are numbered within their length, by their place in their task's output and the
counts of the tasks before; a piece's number tells its bin.

Defined cases: null or empty text is the end id alone; a null id and repeated rows are
packed as they come; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, sized, tidy

LENGTH, END_ID = 4096, 1
CUT = "part bigint, id bigint, piece int, start bigint, length int, number bigint, ids_crc32 bigint, ids binary"
PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary"


def pieces_of(rows: DataFrame, length: int, end_id: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """The pieces (CUT); number counts the pieces of the same length before in the part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sparkloom.llm.tokens import encoder

        own, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for i, flat, cuts in own.encode(batch.column(1), end_id):
                n = np.diff(cuts)
                count = -(-n // length)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                size = np.minimum(n[row] - start, length)
                order = np.argsort(size, kind="stable")
                kinds, first, many = np.unique(size[order], return_index=True, return_counts=True)
                number = np.empty(len(row), np.int64)
                number[order] = np.arange(len(row)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                data = memoryview(flat.astype("<u4")).cast("B")
                at = (4 * (cuts[row] + start)).tolist()
                spans = [data[a : a + s] for a, s in zip(at, (4 * size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), part, np.int64)), batch.column(0).slice(i, len(n)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(number),
                        pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array([bytes(s) for s in spans] if with_ids else [None] * len(row), pa.binary()),
                    ],
                    ["part", "id", "piece", "start", "length", "number", "ids_crc32", "ids"],
                )
            # or two batches are held while the next one comes
            del batch
        tidy()

    return rows.mapInArrow(encode, CUT)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How often each length is taken so that their sum, at most room, is the largest there is; lengths descend, and of equal sums the one of longer pieces counts."""
    sums, steps, goal, mask = 1, [], 1 << room, (1 << room + 1) - 1
    for x in lengths:
        if x > room:
            continue
        for _ in range(min(counts[x], room // x)):
            more = sums | sums << x & mask
            if more == sums:
                break
            steps.append((x, sums))
            sums = more
            if sums & goal:
                break
        if sums & goal:
            break
    left, taken = sums.bit_length() - 1, {}
    for x, before in reversed(steps):
        if not before >> left & 1:
            taken[x] = taken.get(x, 0) + 1
            left -= x
    return taken


def kinds_of_bins(counts: dict[int, int], length: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, how many pieces of each length) of all bins, by minimum bin slack."""
    left = {x: n for x, n in counts.items() if n > 0}
    lengths, bins = sorted(left, reverse=True), []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        taken = fullest(left, lengths, length - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= n * times
        bins.append((times, taken))
        if any(not left[x] for x in taken):
            lengths = [x for x in lengths if left[x]]
    return bins


def places(bins: list[tuple[int, dict[int, int]]], length: int) -> np.ndarray:
    """Rows of (length, number of its first piece, pieces in a bin, first bin, offset of the first), sorted; one for each kind of bin and length in it."""
    seen, bin_no, rows = {}, 0, []
    for times, taken in bins:
        at = 0
        for x in sorted(taken, reverse=True):
            rows.append((x, seen.get(x, 0), taken[x], bin_no, at))
            seen[x] = seen.get(x, 0) + taken[x] * times
            at += x * taken[x]
        bin_no += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(table: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces from their lengths and numbers within them."""
    found = np.zeros(len(size), np.int64)
    kinds, start = np.unique(table[:, 0], return_index=True)
    ends = np.append(start[1:], len(table))
    order = np.argsort(size, kind="stable")
    own, first, many = np.unique(size[order], return_index=True, return_counts=True)
    for x, a, n in zip(own.tolist(), first.tolist(), many.tolist(), strict=True):
        k = int(np.searchsorted(kinds, x))
        rows = order[a : a + n]
        found[rows] = start[k] + np.searchsorted(table[start[k] : ends[k], 1], number[rows], "right") - 1
    row = table[found]
    inner = number - row[:, 1]
    return row[:, 3] + inner // row[:, 2], row[:, 4] + inner % row[:, 2] * size


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece (PIECES); ids are the piece's ids as little-endian 32-bit integers, null unless with_ids."""
    pieces = durable(pieces_of(id_text(docs, id_col, text_col), length, end_id, vocabulary, with_ids), "pieces", "zstd")
    # each part's pieces of a length: never more rows than pieces
    counts = durable(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = durable(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before")
    # at most ``length`` rows
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(kinds_of_bins(totals, length), length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset = placed(table, size, batch.column("number").to_numpy() + batch.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start")), pa.array(size), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset), batch.column("ids")],
                [c.split()[0] for c in PIECES.split(", ")],
            )

    return pieces.join(sized(before), ["part", "length"]).select("id", "piece", "start", "length", "number", "before", "ids_crc32", "ids").mapInArrow(place, PIECES)


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


QUERIES = {"op11_bin_slack": op11_bin_slack}
ORACLES: dict[str, str] = {}
