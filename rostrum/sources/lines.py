"""JSON-lines logs as a data source: read by byte ranges, tailed while they grow, and appended to with a commit of its own.

    spark.dataSource.register(JsonLines)
    spark.read.format("json_lines").load(path)
    spark.readStream.format("json_lines").load(path)
    records.write.format("json_lines").mode("append").save(path)

A log is a file, or a folder of files whose names don't start with ``_`` or ``.``.
Rows are file, head, at and value: the line (without its end), the byte where it
begins, and a fingerprint of the file's first line, which tells a file that was cut
and begun anew from one that grew. Only lines that end in a newline are read; an
empty file gives none. Files are cut into ranges of ``split_bytes``, or wider ones
where one read would have over RANGES of them, each read by one task; a line belongs to the range in which it begins, however long it is.
Invalid UTF-8 is replaced. Paths may be local or of any store that Arrow opens.

Tail. An offset holds, for each file, the byte after its last whole line and its
head. A file that is shorter than its offset, or has another head, is read from its
start; a file that goes takes its offset with it. Offsets are Spark's to keep, so a
restart repeats and misses nothing. A planned range that is no longer there fails
the batch, unless ``fail_on_data_loss`` is false.

Append. Tasks write staged files, which no reader sees. The commit puts their names
into a manifest of its own number, which only one writer can make, and then gives
them their names; what a lost driver leaves undone, the next writer does or clears.
A half-written last line is cut off before anything is added.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, head string, at bigint, value string"
#: Bytes of a range, bytes read at a time, and bytes of lines in one Arrow batch.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
#: Ranges of one read from which they become wider, up to SPLIT_BYTES: a task has costs of its own, however little it reads.
RANGES = 128


class LogError(ValueError):
    """A log that can't be read on or added to as it is."""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def log_files(fs: pafs.FileSystem, root: str) -> dict[str, int]:
    """Sizes of a log's files, by path in order of names; none if there is no log."""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return {root: info.size}
    if info.type == pafs.FileType.NotFound:
        return {}
    found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name[0] not in "_."]
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path)}


def _chunks(fs: pafs.FileSystem, path: str, start: int) -> Iterator[bytes]:
    with fs.open_input_file(path) as f:
        f.seek(start)
        while data := f.read(READ_BYTES):
            yield data


def head_of(fs: pafs.FileSystem, path: str) -> str | None:
    """A fingerprint of the first line, None if it has no end yet. Sums run over the line, which isn't held."""
    crc = size = 0
    for data in _chunks(fs, path, 0):
        cut = data.find(b"\n")
        part = data if cut < 0 else data[: cut + 1]
        crc, size = zlib.crc32(part, crc), size + len(part)
        if cut >= 0:
            return f"{crc:08x}-{size}"
    return None


def whole_until(fs: pafs.FileSystem, path: str, size: int) -> int:
    """The byte after the last newline, looked for from the end."""
    with fs.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(end - READ_BYTES, 0)
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``stop``; whole lines end at ``end``."""

    path: str
    head: str
    start: int
    stop: int
    end: int
    first: bool
    lossless: bool = True


def width(split: int, total: int) -> int:
    """Bytes of a range where so many bytes are read in all."""
    return max(split, min(-(-total // RANGES), SPLIT_BYTES))


def ranges(path: str, head: str, start: int, end: int, split: int, lossless: bool = True) -> list[Range]:
    return [Range(path, head, at, min(at + split, end), end, at == start, lossless) for at in range(start, end, split)]


def read_range(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of one range, some megabytes at a time."""
    fs, _ = opened(root)
    info = fs.get_file_info(part.path)
    if info.type != pafs.FileType.File or info.size < part.end or head_of(fs, part.path) != part.head:
        if part.lossless:
            raise LogError(f"{part.path} no longer holds the bytes up to {part.end} that were planned")
        return
    lines, places, held = [], [], 0
    with fs.open_input_file(part.path) as raw:
        # the line that holds the byte before a range is the range's before, unless it ends there
        at = part.start - (not part.first)
        raw.seek(at)
        source = io.BufferedReader(raw, READ_BYTES)
        if not part.first:
            at += len(source.readline())
        while at < part.stop:
            line = source.readline()
            lines.append(line[:-1].removesuffix(b"\r").decode("utf-8", "replace"))
            places.append(at)
            at, held = at + len(line), held + len(line)
            if held >= BATCH_BYTES:
                yield _batch(part, places, lines)
                lines, places, held = [], [], 0
    if lines:
        yield _batch(part, places, lines)


def _batch(part: Range, places: list[int], lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.record_batch([pa.array([part.path] * n), pa.array([part.head] * n), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "head", "at", "value"])


class JsonLines(DataSource):
    """Options: path, split_bytes, fail_on_data_loss; for writing also expected, the number of the commit to make."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Tail:
        return Tail(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise LogError("a log is appended to; remove it to begin anew")
        if len(schema) != 1 or schema[0].dataType.typeName() != "string":
            raise LogError("a log takes one column of lines")
        return Writer(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        fs, root = opened(self.root)
        ends = {path: whole_until(fs, path, size) for path, size in log_files(fs, root).items()}
        split, found = width(self.split, sum(ends.values())), []
        for path, end in ends.items():
            if end:
                found += ranges(path, head_of(fs, path), 0, end, split)
        return found or [Range("", "", 0, 0, 0, True, False)]  # Spark asks for one at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition)


class Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.lossless = options.get("fail_on_data_loss", "true").lower() != "false"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = opened(self.root)
        found = {}
        for path, size in log_files(fs, root).items():
            head = head_of(fs, path)
            # before its first line has an end a file is at 0: its offset shows if it was cut to nothing
            found[path] = {"at": 0 if head is None else whole_until(fs, path, size), "head": head or ""}
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        news = []
        for path, now in sorted(end.items()):
            was = start.get(path, {"at": 0, "head": ""})
            news.append((path, now["head"], was["at"] if was["head"] == now["head"] and was["at"] <= now["at"] else 0, now["at"]))
        split = width(self.split, sum(stop - begin for *_, begin, stop in news))
        return [part for new in news for part in ranges(*new, split, self.lossless)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition)


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


def manifests(fs: pafs.FileSystem, root: str) -> dict[int, str]:
    """Paths of a log's manifests by number."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return {int(f.base_name.split(".")[0]): f.path for f in found if f.base_name.endswith(".json")}


def _exclusively(fs: pafs.FileSystem, path: str, body: bytes) -> bool:
    """Writes a file that wasn't there, whole or not at all; False if there is one. Stores other than local ones are asked first."""
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(body)
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(aside, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(aside)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(aside)
        return False
    fs.move(aside, path)
    return True


def roll_forward(fs: pafs.FileSystem, root: str, clear: bool = False) -> int:
    """Gives staged files of committed manifests their names, with ``clear`` removes all others, and returns the next commit's number."""
    known = manifests(fs, root)
    for number, path in sorted(known.items()):
        with fs.open_input_file(path) as f:
            names = json.loads(f.read())["files"]
        for k, name in enumerate(names):
            if fs.get_file_info(f"{root}/_staged/{name}").type == pafs.FileType.File:
                fs.move(f"{root}/_staged/{name}", f"{root}/log-{number:010d}-{k:05d}.jsonl")
    if clear and fs.get_file_info(f"{root}/_staged").type == pafs.FileType.Directory:
        fs.delete_dir_contents(f"{root}/_staged")
    return max(known, default=-1) + 1


def mend_tail(fs: pafs.FileSystem, path: str, size: int) -> str | None:
    """Makes a file end in a newline: a last line that is no JSON is cut off, one that is whole gets its end. What was done."""
    end = whole_until(fs, path, size)
    if end == size:
        return None
    with fs.open_input_file(path) as f:
        f.seek(end)
        last = f.read(size - end)
    try:
        json.loads(last)
        done, more = "completed", last + b"\n"
    except ValueError:
        done, more = "cut", b""
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        left = end
        for data in _chunks(fs, path, 0) if end else ():
            out.write(data[:left])
            left -= len(data[:left])
            if not left:
                break
        out.write(more)
    fs.move(aside, path)
    return done


def prepared(path: str) -> int:
    """A log ready to be added to: commits finished, files of lost jobs cleared, torn tails mended. The number of the next commit."""
    fs, root = opened(path)
    fs.create_dir(f"{root}/_commits", recursive=True)
    number = roll_forward(fs, root, clear=True)
    for name, size in log_files(fs, root).items():
        mend_tail(fs, name, size)
    return number


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.job = options["path"], uuid.uuid4().hex
        self.expected = int(options["expected"]) if "expected" in options else prepared(self.root)

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        fs, root = opened(self.root)
        fs.create_dir(f"{root}/_staged", recursive=True)
        context = TaskContext.get()
        name, rows = f"{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}.jsonl", 0
        with fs.open_output_stream(f"{root}/_staged/{name}") as out:
            for row in iterator:
                if row[0] is None or "\n" in row[0]:
                    raise LogError("a line of a log is text without line ends")
                out.write(row[0].encode() + b"\n")
                rows += 1
        return Staged(name, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.root)
        names = [m.name for m in messages if m is not None and m.rows]
        body = json.dumps({"files": names, "rows": sum(m.rows for m in messages if m is not None)}).encode()
        if names and not _exclusively(fs, f"{root}/_commits/{self.expected:010d}.json", body):
            raise LogError(f"another writer has made commit {self.expected} of {self.root}")
        roll_forward(fs, root)
        self._clear(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        """Removes what this job's attempts have staged and no manifest names: tasks that failed leave files too."""
        for f in fs.get_file_info(pafs.FileSelector(f"{root}/_staged", allow_not_found=True)):
            if f.base_name.startswith(self.job):
                fs.delete_file(f.path)
