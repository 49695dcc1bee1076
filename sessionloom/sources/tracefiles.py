"""A Python data source for trace files: readers with file splits, column and time pushdown, and a committing writer.

``register(spark)`` makes two formats known:

* ``trace_log`` reads line logs and NPZ traces below a folder as (session_id, seq, t, direction, length). Line logs are cut into
  splits of ``split_bytes``; every split knows the first line, from which time counts. A task takes splits up to some size and
  number, so many small files make few tasks. A schema with fewer columns reads and parses only those, and ``t <`` filters are
  applied where lines are parsed.
* ``file_blocks`` reads files as (file, path, block, bytes, digest): SHA-256 of each block of ``block_bytes``, a file of any size in many tasks.
* ``named_files`` writes rows to the file that each names: (file, line) as text with ``encoding``, or (file, times, directions,
  lengths) as NPZ arrays. Rows of a file come together and in order. Each task writes to a staging folder of its own attempt; only the
  commit moves the folders of successful attempts into place, one rename a task, so files appear whole or not at all.

Folders are opened through Arrow's file systems, so any shared store that Arrow knows will do.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..runtime import ship_package

PACKETS = "session_id string, seq bigint, t double, direction int, length double"
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 50_000
TASK_BYTES, TASK_FILES = 64 << 20, 2_000  # of one task of a trace reader
_SENT = {b"s": 1, b"sent": 1, b"send": 1, b"r": 0, b"received": 0, b"recv": 0}


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    local = re.sub(r"^file:/+", "/", root)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(root)


@dataclass
class Split(InputPartition):
    """Bytes ``start`` to ``end`` of a file; a line belongs to the split in which it starts."""

    path: str
    start: int
    end: int


@dataclass
class Share(InputPartition):
    """What one task reads: (folder, names joined by ``/``, start, end); whole files have no end. Names are told once and kept as one text."""

    parts: list[tuple[str, str, int, int | None]]


class TraceReader(DataSourceReader):
    """Reads one form of trace, ``line`` or ``npz``, from files whose name fits the regular expression ``pattern``."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.form = options["path"], options.get("form", "line")
        self.pattern = options.get("pattern", r"\.npz$" if self.form == "npz" else r"[0-9]\.log$")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.columns = [f.name for f in schema.fields]
        self.before, self.upto = np.inf, np.inf
        if self.form not in ("line", "npz"):
            raise ValueError(f"unknown form {self.form}")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, LessThan) and f.attribute == ("t",):
                self.before = min(self.before, float(f.value))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("t",):
                self.upto = min(self.upto, float(f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        """Shares of about ``TASK_BYTES`` or ``TASK_FILES``; larger line logs are cut where a split ends. One folder is listed at a time."""
        system, path = opened(self.root)
        step = max(1, TASK_BYTES // self.split_bytes) * self.split_bytes if self.form == "line" else 1 << 62
        shares, parts, taken, files, todo = [], [], 0, 0, [path]
        while todo:
            entries = sorted(system.get_file_info(fs.FileSelector(folder := todo.pop())), key=lambda f: f.path)
            todo += [f.path for f in reversed(entries) if not f.is_file]
            names = []
            for f in entries:
                if not f.is_file or not re.search(self.pattern, f.base_name):
                    continue
                if f.size > step:
                    shares += [Share([(folder, f.base_name, at, min(f.size, at + step))]) for at in range(0, f.size, step)]
                    continue
                names.append(f.base_name)
                taken, files = taken + f.size, files + 1
                if taken >= TASK_BYTES or files == TASK_FILES:
                    shares.append(Share([*parts, (folder, "/".join(names), 0, None)]))
                    parts, names, taken, files = [], [], 0, 0
            if names:
                parts.append((folder, "/".join(names), 0, None))
        return [*shares, Share(parts)] if parts else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        """Rows of many small files come in one batch."""
        held, rows = [], 0
        for batch in self._batches(partition):
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for folder, names, start, end in partition.parts:
            for path in (f"{folder}/{name}" for name in names.split("/")):
                at, stop = start, start + 1
                while at < stop:
                    with system.open_input_file(path) as file:
                        if self.form == "npz":
                            yield from self._arrays(file, path)
                            break
                        stop = file.size() if end is None else end
                        yield from self._lines(file, Split(path, at, min(stop, at + self.split_bytes)))
                    at += self.split_bytes

    def _batch(self, path: str, seq, t, direction, length) -> pa.RecordBatch:
        keep = np.flatnonzero((t < self.before) & (t <= self.upto))
        made = {"session_id": lambda: pa.array([path] * len(keep), pa.string()), "seq": lambda: pa.array(np.asarray(seq)[keep], pa.int64()),
                "t": lambda: pa.array(t[keep]), "direction": lambda: pa.array(direction, pa.int32()).take(pa.array(keep)),
                "length": lambda: pa.array(length, pa.float64()).take(pa.array(keep))}
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)

    def _lines(self, file: pa.NativeFile, split: Split) -> Iterator[pa.RecordBatch]:
        """Lines ``rel_ns,direction,length,...`` of a split; a line that is no packet has null direction and length."""
        text = io.BufferedReader(file)
        first = None
        while first is None and (line := text.readline()):
            field = line.lstrip(b"\xef\xbb\xbf").strip().split(b",")[0]
            first = float(field) / 1e9 if field else None
        if first is None:
            return
        text.seek(max(0, split.start - 1))
        if split.start:
            text.readline()
        wants_way, wants_length = "direction" in self.columns, "length" in self.columns
        at = text.tell()
        while at < split.end:
            seq, t, ways, lengths = [], [], [], []
            while at < split.end and len(seq) < BATCH_ROWS and (line := text.readline()):
                start, at = at, at + len(line)
                f = line.lstrip(b"\xef\xbb\xbf").strip().split(b",")
                if not f[0]:
                    continue
                seq.append(start)
                t.append(float(f[0]) / 1e9 - first)
                ways.append(_SENT.get(f[1].strip().lower()) if wants_way and len(f) > 1 else None)
                lengths.append(float(f[2]) if wants_length and len(f) > 2 else None)
            if not seq:
                break
            yield self._batch(split.path, seq, np.array(t), ways, lengths)

    def _arrays(self, file: pa.NativeFile, path: str) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(file.read()), allow_pickle=False) as raw:
            times = np.asarray(raw["times"], dtype=float)
            ways = np.asarray(raw["directions"]) if "direction" in self.columns else None
            lengths = np.asarray(raw["lengths"], dtype=float) if "length" in self.columns else None
        for lo in range(0, len(times), BATCH_ROWS):
            part = slice(lo, lo + BATCH_ROWS)
            n = len(times[part])
            yield self._batch(path, np.arange(lo, lo + n), times[part] - times.min(), [None] * n if ways is None else ways[part].astype(np.int32),
                              [None] * n if lengths is None else lengths[part])


class TraceLog(DataSource):
    """Format ``trace_log``."""

    @classmethod
    def name(cls) -> str:
        return "trace_log"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(self.options, schema)


class BlockReader(DataSourceReader):
    """Digests of fixed-size blocks; a split holds whole blocks of one file."""

    def __init__(self, options: dict):
        self.root, self.pattern, self.block = options["path"], options.get("pattern", "."), int(options.get("block_bytes", 8 << 20))

    def partitions(self) -> list[Split]:
        system, path = opened(self.root)
        files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and re.search(self.pattern, f.base_name)]
        step = self.block * max(1, SPLIT_BYTES // self.block)
        return [Split(f.path, at, min(f.size, at + step)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), step)]

    def read(self, partition: Split) -> Iterator[tuple]:
        system, _ = opened(self.root)
        name = partition.path.rsplit("/", 1)[1]
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, max(partition.end, partition.start + 1), self.block):
                data = file.read_at(self.block, at) if partition.end > at else b""
                yield name, partition.path, at // self.block, len(data), sha256(data).hexdigest()


class FileBlocks(DataSource):
    """Format ``file_blocks``."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "file string, path string, block bigint, bytes bigint, digest string"

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """Staging folder of a task that has ended well, and its files."""

    folder: str
    files: int


class NamedFileWriter(DataSourceArrowWriter):
    """Writes each row to the file it names, below a staging folder until the job commits."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.staging = f".staging-{uuid.uuid4().hex}"
        self.arrays = [f.name for f in schema.fields] != ["file", "line"]
        if self.arrays and [f.name for f in schema.fields] != ["file", "times", "directions", "lengths"]:
            raise ValueError("columns must be file, line or file, times, directions, lengths")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = opened(self.root)
        folder = f"part-{context.partitionId():05d}"
        place = f"{root}/{self.staging}/{context.taskAttemptId()}"
        name, out, held, done, home = None, None, [], set(), None

        def close():
            if name is None:
                return
            if self.arrays:
                joined = {k: np.concatenate([h[i] for h in held]) for i, k in enumerate(("times", "directions", "lengths"))}
                packed = io.BytesIO()
                np.savez(packed, **joined)
                out.write(packed.getvalue())
                held.clear()
            out.close()

        for batch in iterator:
            files = batch.column("file").to_pylist()
            starts = [i for i, f in enumerate(files) if i == 0 or f != files[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(files)], strict=True):
                if files[lo] != name:
                    close()
                    name = files[lo]
                    if name in done:
                        raise ValueError(f"rows of {name} are apart")
                    done.add(name)
                    if (folder_of := f"{place}/{name}".rsplit("/", 1)[0]) != home:
                        system.create_dir(home := folder_of, recursive=True)
                    out = system.open_output_stream(f"{place}/{name}")
                    if not self.arrays and self.encoding == "utf-8-sig":
                        out.write(b"\xef\xbb\xbf")
                if self.arrays:
                    part = batch.slice(lo, hi - lo)
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("times", "directions", "lengths")])
                else:
                    out.write("".join(f"{line}\n" for line in batch.column("line").slice(lo, hi - lo).to_pylist()).encode())
        close()
        return Written(f"{context.taskAttemptId()}|{folder}", len(done))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        for message in messages:
            if message is not None and message.files:
                attempt, folder = message.folder.split("|")
                system.move(f"{root}/{self.staging}/{attempt}", f"{root}/{folder}-{self.staging[9:17]}")
        self._drop(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*opened(self.root))

    def _drop(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")


class NamedFiles(DataSource):
    """Format ``named_files``; only for writing."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets filters reach them."""
    ship_package(spark)
    spark.dataSource.register(TraceLog)
    spark.dataSource.register(NamedFiles)
    spark.dataSource.register(FileBlocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_named(rows: DataFrame, root: str, together: list[str], order: list[str], encoding: str = "utf-8") -> None:
    """Writes ``rows`` (file, and line or times, directions, lengths) below ``root``: files of equal ``together`` share a folder, rows
    follow in ``order``. A file is written by one task as a stream; arrays of one NPZ are held by it."""
    register(rows.sparkSession)
    columns = ["file", "line"] if "line" in rows.columns else ["file", "times", "directions", "lengths"]
    rows.repartition(*together).sortWithinPartitions(*together, "file", *order).select(*columns).write.format("named_files").mode("append").option(
        "path", root).option("encoding", encoding).save()
