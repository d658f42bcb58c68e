"""A data source in Python: a Parquet table in batches of row groups, as a stream that can be replayed, and as a sink with a commit."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "sparkloom_replay"


def opened(path: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The Parquet files of a folder, or the file itself, in order of their names."""
    from pyarrow import fs

    system, root = opened(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


@dataclass
class RowGroup(InputPartition):
    file: str
    number: int


@dataclass
class Block(InputPartition):
    """A run of blocks, and the row groups that they need, if these are known: (file, number, first row, rows)."""

    number: int
    count: int = 1
    groups: list[tuple[str, int, int, int]] | None = None


#: Rows of a stream's partition and of a row group of a sink, where there are so many; bytes of such a row group; and how many partitions a stream has before its blocks are put together.
ROWS, GROUP_BYTES, PARTITIONS = 100_000, 1 << 26, 64


class Groups(DataSourceReader):
    """A partition for each row group of each file."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        system, _ = opened(self.path)
        out = []
        for f in files_of(self.path):
            with system.open_input_file(f) as raw:
                out += [RowGroup(f, k) for k in range(pq.ParquetFile(raw).metadata.num_row_groups)]
        return out

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow.parquet as pq

        if partition is None:
            return
        with opened(self.path)[0].open_input_file(partition.file) as raw:
            yield from pq.ParquetFile(raw).iter_batches(row_groups=[partition.number], columns=self.columns)


class Replay(DataSourceStreamReader):
    """Blocks of ``rows`` rows one after another; every ``late``-th row of a block comes with the next one.

    Which rows a block has depends on its number alone, so a batch that is run again, or a
    stream that goes on from its checkpoint, sees the same rows.
    """

    def __init__(self, path: str, columns: list[str], rows: int, late: int):
        self.path, self.columns, self.rows, self.late = path, columns, rows, late

    def sizes(self) -> list[tuple[str, int]]:
        import pyarrow.parquet as pq

        system, out = opened(self.path)[0], []
        for f in files_of(self.path):
            with system.open_input_file(f) as raw:
                out.append((f, pq.ParquetFile(raw).metadata.num_rows))
        return out

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        blocks = -(-sum(n for _, n in self.sizes()) // self.rows)
        return {"block": blocks + 1 if blocks and self.late else blocks}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Blocks, or runs of them where they are many; each with its row groups, so no task reads other files' footers."""
        n = end["block"] - start["block"]
        run = max(1, min(-(-n // PARTITIONS), ROWS // self.rows))
        groups = self.groups()
        ends = [at + size for _, _, at, size in groups]
        out = []
        for k in range(start["block"], end["block"], run):
            count = min(run, end["block"] - k)
            low = bisect_right(ends, max(k - 1, 0) * self.rows)
            high = bisect_left(ends, (k + count) * self.rows) + 1
            out.append(Block(k, count, groups[low:high]))
        return out

    def groups(self) -> list[tuple[str, int, int, int]]:
        """(file, number, first row, rows) of all row groups."""
        import pyarrow.parquet as pq

        system, out, at = opened(self.path)[0], [], 0
        for f in files_of(self.path):
            with system.open_input_file(f) as raw:
                found = pq.ParquetFile(raw).metadata
                for k in range(found.num_row_groups):
                    n = found.row_group(k).num_rows
                    out.append((f, k, at, n))
                    at += n
        return out

    def slice(self, first: int, after: int, groups: list[tuple[str, int, int, int]]) -> Iterator:
        """Batches of the rows of all files from first to before after, with the number of each batch's first row."""
        import pyarrow.parquet as pq

        system = opened(self.path)[0]
        for f, k, here, n in groups:
            if here >= after or here + n <= first:
                continue
            with system.open_input_file(f) as raw:
                for batch in pq.ParquetFile(raw).iter_batches(row_groups=[k], columns=self.columns):
                    low, high = max(first - here, 0), min(after - here, batch.num_rows)
                    if low < high:
                        yield here + low, batch.slice(low, high - low)
                    here += batch.num_rows
                    if here >= after:
                        break

    def read(self, partition: Block) -> Iterator:
        import numpy as np
        import pyarrow as pa

        first, after = partition.number, partition.number + partition.count
        groups = self.groups() if partition.groups is None else partition.groups
        # the last block read and its late rows, which come with the next one
        block, kept = first - 1, []
        for at, batch in self.slice(max(first - bool(self.late), 0) * self.rows, after * self.rows, groups):
            done = 0
            while done < batch.num_rows:
                k = (at + done) // self.rows
                part = batch.slice(done, (k + 1) * self.rows - at - done)
                if k > block:
                    yield from kept
                    block, kept = k, []
                late = np.arange(at + done, at + done + part.num_rows) % self.late == 0 if self.late else np.zeros(part.num_rows, bool)
                kept.append(part.filter(pa.array(late)))
                if k >= first:
                    yield part.filter(pa.array(~late))
                done += part.num_rows
        if block + 1 < after:
            yield from kept

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class Wrote(WriterCommitMessage):
    name: str
    rows: int


class _Files:
    """Tasks write hidden files; the commit gives those their names that its messages tell of."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator) -> Wrote:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        with system.open_output_stream(f"{root}/.{name}") as raw:
            held, size = [], 0

            def put() -> None:
                nonlocal writer
                writer = writer or pq.ParquetWriter(raw, held[0].schema)
                writer.write_table(pa.Table.from_batches(held))

            # small batches share a row group, which is a task when the table is read
            for batch in batches:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if sum(b.num_rows for b in held) >= ROWS or size >= GROUP_BYTES:
                    put()
                    held, size = [], 0
            if held:
                put()
            if writer:
                writer.close()
        if not rows:
            system.delete_file(f"{root}/.{name}")
        return Wrote(name, rows)

    def show(self, messages: list[Wrote | None], manifest: str) -> None:
        """The manifest is written before files get their names; where one is there, the batch was committed and its own files count."""
        from pyarrow import fs

        system, root = opened(self.path)
        place = f"{root}/_{manifest}.json"
        if system.get_file_info(place).type == fs.FileType.NotFound:
            names = [m.name for m in messages if m and m.rows]
            with system.open_output_stream(f"{root}/.{manifest}.tmp") as raw:
                raw.write(json.dumps(names).encode())
            system.move(f"{root}/.{manifest}.tmp", place)
        with system.open_input_stream(place) as raw:
            names = json.loads(raw.read())
        for n in names:
            if system.get_file_info(f"{root}/.{n}").type != fs.FileType.NotFound:
                system.move(f"{root}/.{n}", f"{root}/{n}")
        self.forget([m for m in messages if m and m.name not in names])

    def forget(self, messages: list[Wrote | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.path)
        for m in messages:
            if m and system.get_file_info(f"{root}/.{m.name}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/.{m.name}")


class BatchSink(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Wrote | None]) -> None:
        self.show(messages, f"job-{uuid.uuid4().hex}")

    def abort(self, messages: list[Wrote | None]) -> None:
        self.forget(messages)


class StreamSink(_Files, DataSourceStreamArrowWriter):
    """A batch that is committed again keeps the files that it had."""

    def commit(self, messages: list[Wrote | None], batchId: int) -> None:
        self.show(messages, f"batch-{batchId}")

    def abort(self, messages: list[Wrote | None], batchId: int) -> None:
        self.forget(messages)


class ReplaySource(DataSource):
    """``spark.read.format(NAME).load(path)``; for streams also the options rows (of a block) and late (every which row comes a block later, 0 for none)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} holds no Parquet file")
        with opened(self.options["path"])[0].open_input_file(files[0]) as raw:
            return from_arrow_schema(pq.read_schema(raw), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> Groups:
        return Groups(self.options["path"], schema.names)

    def streamReader(self, schema: StructType) -> Replay:
        rows, late = int(self.options.get("rows", "100000")), int(self.options.get("late", "0"))
        if rows < 1 or late < 0:
            raise ValueError("a block has one row at least, and late is not negative")
        return Replay(self.options["path"], schema.names, rows, late)

    def writer(self, schema: StructType, overwrite: bool) -> BatchSink:
        if overwrite:
            raise ValueError("this sink only appends")
        return BatchSink(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamSink:
        return StreamSink(self.options["path"])
