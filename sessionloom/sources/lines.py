"""Log files as line tables with a stable line order, and the parsing helpers shared by the readers.

Folders may hold millions of small files: tasks list them and open them, many in one task, and the driver never has a list of them.
Paths are opened through Arrow's file systems.
"""

from __future__ import annotations

import csv
import os
import sys
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, ship_package
from .tracefiles import opened

SPLIT_BYTES = 16 << 20  # of a file read by one task at a time
BATCH_ROWS = 20_000
LISTED = "path string, length bigint, folder boolean"


def file_uri(column: str) -> Column:
    """Path column with local paths in one spelling (three slashes)."""
    return F.regexp_replace(F.col(column), "^file:/+", "file:///")


def _place(root: str) -> tuple[str, str, str]:
    """Root as Arrow takes it, its path in its file system, and what makes such a path a URI."""
    local = "://" not in root or root.startswith("file:")
    root = os.path.abspath(root) if local and not root.startswith("file:") else root.rstrip("/")
    path = opened(root)[1]
    return root, path, "file://" if local else root.removesuffix(path.rstrip("/"))


def _batches(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``BATCH_ROWS``, whatever the number of files they come from."""
    schema, held = pa.schema(types), []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _listing(root: str, prefix: str, pattern: str | None):
    """Replaces folders by what is in them: one level down, or with a ``pattern`` all files below whose names fit it.

    Names that start with a dot or an underscore are passed over, as Spark does.
    """
    def rows(batches):
        system, _ = opened(root)
        for batch in batches:
            for path, length, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not folder and (pattern is None or fnmatchcase(path.rsplit("/", 1)[1], pattern)):
                    yield path, length, False
                todo = [path] if folder else []
                while todo:
                    for e in system.get_file_info(fs.FileSelector(todo.pop().removeprefix(prefix))):
                        if e.base_name.startswith(".") or e.base_name.startswith("_") and "=" not in e.base_name:
                            continue
                        if e.is_file and (pattern is None or fnmatchcase(e.base_name, pattern)):
                            yield prefix + e.path, e.size, False
                        elif not e.is_file and pattern is not None:
                            todo.append(prefix + e.path)
                        elif not e.is_file:
                            yield prefix + e.path, 0, True

    return lambda batches: _batches(rows(batches), [("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def _tasks(spark: SparkSession) -> int:
    """Tasks that open files: their rows are too short for Spark to tell the work from the size."""
    return 3 * spark.sparkContext.defaultParallelism


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, folder, length) of the files under ``root`` whose name fits the glob ``pattern`` (*, ?, [..]); contents are not read.

    One task lists the root, many list its folders, and many walk down from there.
    """
    ship_package(spark)
    root, path, prefix = _place(root)
    found = opened(root)[0].get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    rows = spark.createDataFrame([(prefix + path, found.size or 0, not found.is_file)], LISTED)
    for _ in range(2):
        rows = rows.mapInArrow(_listing(root, prefix, None), LISTED).repartition(_tasks(spark))
    return rows.mapInArrow(_listing(root, prefix, pattern), LISTED).select(
        "path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "length")


def open_files(spark: SparkSession, root: str, pattern: str, rows: Callable, types: list[tuple[str, pa.DataType]], split: bool = True) -> DataFrame:
    """Rows that ``rows(file, path, start, end)`` gives for each piece of each file; pieces have ``SPLIT_BYTES`` at most, or are whole files.

    The list of pieces is materialised as it is dealt out: a join would otherwise take the size of the list, known from its shuffles, for
    that of the files and broadcast their contents.
    """
    place, _, prefix = _place(root)
    size = SPLIT_BYTES if split else 1 << 62
    pieces = list_files(spark, root, pattern).select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("start"))

    def each(batches):
        system, _ = opened(place)
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path.removeprefix(prefix)) as file:
                    yield from rows(file, path, start, min(length, start + size))

    names = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double", pa.int32(): "int"}
    ddl = ", ".join(f"`{n}` {names[t]}" for n, t in types)
    return cut_lineage(pieces.repartition(_tasks(spark))).mapInArrow(lambda batches: _batches(each(batches), types), ddl)


def _ended(file: pa.NativeFile, data: bytes) -> bytes:
    """``data`` and what follows it in the file up to the end of its last line."""
    while data and data[-1:] not in b"\r\n" and (more := file.read(1 << 16)):
        tail = more.splitlines(keepends=True)[0]
        data += tail
    return data


def _lines(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of the lines that start in a piece; lines end with LF, CR or both."""
    at = max(0, start - 1)
    file.seek(at)
    for i, line in enumerate(_ended(file, file.read(end - at)).splitlines(keepends=True)):
        if (i or not start) and at < end:
            yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
        at += len(line)


def read_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, seq, line) of every file under ``root`` whose name matches the glob ``pattern``; ``seq`` is where the line starts."""
    def rows(file, path, start, end):
        for at, line in _lines(file, start, end):
            yield path, at, line.removeprefix("\ufeff").strip(" ")

    return open_files(spark, root, pattern, rows, [("path", pa.string()), ("seq", pa.int64()), ("line", pa.string())])


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of every file under ``root`` whose name matches the glob ``pattern``, each as a whole, without a byte-order mark."""
    def rows(file, path, start, end):
        yield path, file.read().decode("utf-8-sig", "replace")

    return open_files(spark, root, pattern, rows, [("path", pa.string()), ("text", pa.string())], split=False)


def _top(file: pa.NativeFile) -> tuple[int, str] | None:
    """Offset and text of the first line that is not blank."""
    size = 1 << 16
    while (top := next((x for x in _lines(file, 0, size) if x[1].strip()), None)) is None and size < file.size():
        size *= 2
    return top


def _fields(line: str) -> list[str]:
    return next(csv.reader([line], escapechar="\\")) if '"' in line or "\\" in line else line.split(",")


def read_table(spark: SparkSession, root: str, name: str, columns: list[str]) -> DataFrame:
    """(path, seq, columns...) of every CSV file called ``name`` under ``root``; all values are text, absent ones null.

    A file's first line that is not blank names its columns, for every piece of the file; a record is a line.
    """
    def rows(file, path, start, end):
        csv.field_size_limit(sys.maxsize)
        top = _top(file)
        if top is None:
            return
        names = [n.lstrip("\ufeff") for n in _fields(top[1])]
        places = [names.index(c) if c in names else len(names) for c in columns]
        for at, line in _lines(file, start, end):
            if at > top[0] and line.strip():
                values = _fields(line)
                yield path, at, *[values[i] or None if i < min(len(values), len(names)) else None for i in places]

    return open_files(spark, root, name, rows, [("path", pa.string()), ("seq", pa.int64()), *[(c, pa.string()) for c in columns]])


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, digest): SHA-256 of each file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select(file_uri("path").alias("path"), F.sha2("content", 256).alias("digest"))


def number(text) -> Column:
    """Text as DOUBLE, null when it is not a number."""
    column = F.col(text) if isinstance(text, str) else text
    return F.trim(column).try_cast("double")


def epoch_seconds(text: str) -> Column:
    """Epoch seconds, or an ISO date-time read as UTC whatever zone it names or the session has."""
    bare = F.regexp_replace(F.trim(F.col(text)), r"(Z|[+-]\d\d:?\d\d)$", "")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), bare.try_cast("timestamp_ntz"))
    return F.coalesce(number(text), micros / F.lit(1e6))
