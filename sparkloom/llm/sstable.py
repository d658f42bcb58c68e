"""Token ids in sorted-string-table shards.

A file holds documents in ascending key order:

    data blocks | index | Bloom filter | footer (56 bytes)

A key is one byte (0, or 1 for a null id, which comes last) and the id as a
big-endian 64-bit integer with its sign bit flipped, so byte order is id order.
An entry of a block is ``shared, unshared, value length`` as varints, the
unshared bytes of the key, and the value: the ids as little-endian integers of
2 bytes (4 if the vocabulary needs them).  Every RESTART-th entry shares
nothing.  Blocks are compressed with zstandard and carry a crc32.  The sparse
index has the last key, place and length of each block, for binary search; the
Bloom filter answers most lookups of absent keys without reading a block.

Rows are range-partitioned by (id, hash of the text), and each attempt of a task
writes one shard under a name of its own.  The table that is returned names the
files of the attempts that count, so what a lost attempt has left is never read,
and nothing is renamed, which object stores can't do at once.  Files go to the
shared folder by pyarrow's filesystems (local, HDFS, S3, GCS).

Defined cases: null text is the end id alone; rows that repeat an id are all
kept, in the order of their texts' hashes; an empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, partitions, running_offsets, scratch_path
from sparkloom.llm.shingles import mix

END_ID = 1
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 16, 10, 7
MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<6Q8s")
SHARDS = "shard bigint, path string, rows bigint, n_tokens bigint"
ROWS = "shard bigint, id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def key_of(i: int | None) -> bytes:
    return b"\1" if i is None else b"\0" + struct.pack(">Q", i + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """BLOOM_HASHES places of each key, by double hashing."""
    x = mix(np.array([int.from_bytes(k, "big") & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) + np.uint64(1))
    a, b = x, mix(x) | np.uint64(1)
    return ((a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Writer:
    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.zip = sink, width, zstandard.ZstdCompressor(1)
        self.place, self.rows, self.tokens = 0, 0, 0
        self.block, self.size, self.count, self.last = [], 0, 0, b""
        self.index, self.keys = [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.count, self.last = self.count + 1, key
        self.keys.append(key)
        self.rows, self.tokens = self.rows + 1, self.tokens + len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.count:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.last, self.place, len(data)))
            self.put(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.size, self.count, self.last = [], 0, 0, b""

    def put(self, data: bytes) -> tuple[int, int]:
        at = self.place
        self.sink.write(data)
        self.place += len(data)
        return at, len(data)

    def close(self) -> None:
        self.flush()
        index = self.put(b"".join(varint(len(k)) + k + varint(p) + varint(n) for k, p, n in self.index))
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        on = np.zeros(bits, np.uint8)
        if self.keys:
            on[bloom_places(self.keys, bits).ravel()] = 1
        bloom = self.put(np.packbits(on).tobytes())
        self.put(FOOTER.pack(*index, *bloom, self.rows, self.width, MAGIC))


class Reader:
    """Reads a shard: ``get`` looks an id up, iteration gives (id, ids) in key order."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        end = source.size()
        *places, self.rows, self.width, magic = FOOTER.unpack(self.part(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        index, at = self.part(*places[:2]), 0
        self.index = []
        while at < len(index):
            n, at = read_varint(index, at)
            key, at = index[at : at + n], at + n
            place, at = read_varint(index, at)
            n, at = read_varint(index, at)
            self.index.append((key, place, n))
        self.bloom = np.frombuffer(self.part(*places[2:]), np.uint8)

    def part(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, n = self.index[block]
        data = self.part(place, n + 4)
        if struct.unpack("<I", data[n:])[0] != zlib.crc32(data[:n]):
            raise ValueError("damaged block")
        data, at, key = self.zip.decompress(data[:n]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            unshared, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.index)):
            for key, value in self.entries(b):
                yield id_of(key), self.ids(value)

    def may_hold(self, key: bytes) -> bool:
        at = bloom_places([key], 8 * len(self.bloom))[0]
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)) & 1).all())

    def get(self, i: int | None) -> list[np.ndarray]:
        """The ids of each row with this id; the first block that can hold it is found by binary search."""
        key = key_of(i)
        if not self.index or not self.may_hold(key):
            return []
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for b in range(low, len(self.index)):
            for k, value in self.entries(b):
                if k == key:
                    found.append(self.ids(value))
                elif k > key:
                    return found
        return found


def open_shard(path: str) -> Reader:
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return Reader(files.open_input_file(at))


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the shards below folder; one row per shard (SHARDS), in key order of shard."""
    rows = id_text(docs, id_col, text_col)
    n = shards or partitions(docs.sparkSession)
    order = [F.asc_nulls_last("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from sparkloom.llm.tokens import encoder

        own, task = encoder(vocabulary), TaskContext.get()
        width = 2 if own.narrow and end_id < 1 << 16 else 4
        shard, writer, sink = task.partitionId(), None, None
        files, root = fs.FileSystem.from_uri(folder)
        name = f"{shard:06d}-{task.taskAttemptId()}.sst"
        for batch in batches:
            if writer is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}")
                writer = Writer(sink, width)
            for i, flat, cuts in own.encode(batch.column(1), end_id):
                data, at = flat.astype(f"<u{width}").tobytes(), (cuts * width).tolist()
                for j, doc in enumerate(batch.column(0).slice(i, len(cuts) - 1).to_pylist()):
                    writer.add(key_of(doc), data[at[j] : at[j + 1]])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "rows": [writer.rows], "n_tokens": [writer.tokens]})

    return durable(ordered.mapInArrow(write, SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(shard, id, at, n_tokens, ids_crc32) of every document in the files; at counts the shard's ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                ids, ns, crcs = [], [], []
                for i, own in open_shard(path):
                    ids.append(i)
                    ns.append(len(own))
                    crcs.append(zlib.crc32(own.tobytes()))
                n = np.array(ns, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard)), pa.array(ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())],
                    ["shard", "id", "at", "n_tokens", "ids_crc32"],
                )

    spread = shards.select("shard", "path").repartition(partitions(shards.sparkSession), "shard")
    return spread.mapInArrow(read, ROWS)


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(documents(spark, sf_dir), scratch_path(spark, "sst"))
    before = running_offsets(shards.select("shard", "n_tokens"), "shard", "n_tokens").select("shard", "before")
    # one row for each shard file
    found = read_shards(shards).join(F.broadcast(before), "shard")
    return found.select(F.col("id").alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op6_sstable": op6_sstable}
ORACLES: dict[str, str] = {}
