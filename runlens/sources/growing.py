"""Files that are only ever appended to, as a stream of numbered lines.

The offset of the stream maps each file to the byte up to which its complete lines were taken; a line that has not
been ended yet waits. New bytes are cut into splits that tasks read on their own. A line's number is the number of
lines before it: how many lines end at the byte where the last trigger stopped stands in a small file per log file,
which the task with the last split of a trigger writes; a split then counts line ends from there to its own begin. If that
note is missing, lines are counted from the top of the file. So numbers are those the batch import gives
(``files.number_lines``), whatever the splits, triggers and restarts were.

The driver lists the folder and looks for the last line end of files that grew; it reads no more than that. An offset
holds an entry per file: watch folders of some hundred thousand files at most with one stream. A trigger takes ``splits_per_file``
splits of a file at most, as each of them counts the ones before. Files that shrink are an error. Names that start with ``_`` or ``.`` are left
alone, as Spark's readers do; so are compressed files, which can not grow line by line.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 4 << 20
TAIL = 64 << 10
SPLIT_BYTES = 64 << 20
SPLITS_PER_FILE = 8
#: Small splits share a task up to so many bytes, as long as there are so many tasks.
TASK_BYTES = 8 << 20
TASKS = 64
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".snappy", ".deflate", ".lz4")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder given as a path or a URI."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def spark_uri(path: str, root: str) -> str:
    """What ``_metadata.file_path`` says of a file below ``root``."""
    plain = re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe="/_-!.~'()*,;:$&+=@"), path)
    scheme = re.match(r"([a-z][\w+.-]*)://([^/]*)", root)
    if not scheme or scheme[1] == "file":
        return f"file:{plain}"
    # object stores have the bucket as the first part of a path
    return f"{scheme[1]}://{scheme[2]}{plain}" if plain.startswith("/") else f"{scheme[1]}://{plain}"


def plain_path(uri: str, root: str) -> str:
    """The path that ``spark_uri`` was given, or that of a file that Spark has listed."""
    path = unquote(uri)
    if "://" not in root or root.startswith("file:"):
        return re.sub("^file:/*", "/", path)
    rest = path.split("://", 1)[-1]
    return "/" + rest.partition("/")[2] if file_system(root)[1].startswith("/") else rest


class _Ends:
    """Counts line ends (LF, CR LF, or CR alone) of consecutive blocks."""

    def __init__(self) -> None:
        self.lines, self.after_cr = 0, False

    def add(self, block: bytes) -> None:
        self.lines += block.count(b"\n") + block.count(b"\r") - block.count(b"\r\n")
        if self.after_cr and block[:1] == b"\n":
            self.lines -= 1
        self.after_cr = block[-1:] == b"\r"


def blocks(file, start: int, end: int) -> Iterator[bytes]:
    file.seek(start)
    while start < end:
        block = file.read(min(BLOCK, end - start))
        if not block:
            raise OSError("the file is shorter than it was")
        start += len(block)
        yield block


def line_start(file, at: int, first: int, end: int) -> int:
    """Where the first line at or after ``at`` begins, of a stretch from ``first`` to ``end`` of whole lines."""
    if at <= first:
        return first
    place = at - 1
    for block in blocks(file, place, end):
        found = block.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(block)
    return end


@dataclass
class Split(InputPartition):
    """Lines of a file that begin in [at, until); the trigger takes [first, end)."""

    path: str
    first: int
    end: int
    at: int
    until: int


@dataclass
class Task(InputPartition):
    """Splits that one task reads, one after the other."""

    splits: list[Split]


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "file string, record_key bigint, value string"

    def streamReader(self, schema) -> "GrowingFilesReader":
        return GrowingFilesReader(self.options)


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.notes = options["path"], options["notes"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.most = self.split * int(options.get("splits_per_file", SPLITS_PER_FILE))
        self.taken: dict[str, int] = {}

    # -- on the driver ---------------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = file_system(self.root)
        listed = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = {f.path: f.size for f in listed if f.is_file and not self._passed_over(f.path[len(folder) :])}
        with ThreadPoolExecutor(16) as pool:
            ends = pool.map(lambda f: self._complete(fs, *f), files.items())
            self.taken = self.taken | {p: e for p, e in zip(files, ends) if e}
        return dict(self.taken)

    @staticmethod
    def _passed_over(below: str) -> bool:
        return any(part[:1] in ("_", ".") for part in below.split("/")) or below.endswith(COMPRESSED)

    def _complete(self, fs: pafs.FileSystem, path: str, size: int) -> int:
        """End of the last whole line that this trigger takes."""
        begin = self.taken[path] if path in self.taken else max((at for at, _ in self._noted(path)), default=0)
        if size < begin:
            raise ValueError(f"{path} was cut to {size} bytes, {begin} of it are read")
        with fs.open_input_file(path) as file:
            end = min(size, begin + self.most)
            at = end
            while at > begin:
                low = max(begin, at - TAIL)
                file.seek(low)
                found = file.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
            # a line longer than a trigger takes: all of it, once it has ended
            later = line_start(file, end + 1, begin, size) if end < size else begin
            if later == size and size > begin:
                file.seek(size - 1)
                return size if file.read(1) == b"\n" else begin
            return later

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.taken = self.taken | end
        splits = [
            Split(path, start.get(path, 0), stop, at, min(at + self.split, stop))
            for path, stop in sorted(end.items())
            for at in range(start.get(path, 0), stop, self.split)
        ]
        share = max(self.split, min(TASK_BYTES, sum(s.until - s.at for s in splits) // TASKS))
        tasks, held = [], share
        for split in splits:
            size = split.until - split.at
            if held + size > share:
                tasks.append(Task([]))
                held = 0
            tasks[-1].splits.append(split)
            held += size
        return tasks

    # -- in tasks --------------------------------------------------------------------------------

    def _note(self, path: str) -> tuple[pafs.FileSystem, str]:
        fs, folder = file_system(self.notes)
        return fs, f"{folder}/{hashlib.md5(path.encode()).hexdigest()}.json"

    def _noted(self, path: str) -> list[list[int]]:
        """(byte, lines before it) of the ends of the last triggers."""
        fs, note = self._note(path)
        if fs.get_file_info(note).type == pafs.FileType.NotFound:
            return []
        with fs.open_input_stream(note) as f:
            return json.loads(f.read())["ends"]

    def _write_note(self, path: str, ends: list[list[int]]) -> None:
        fs, note = self._note(path)
        fs.create_dir(note.rsplit("/", 1)[0], recursive=True)
        part = f"{note}.{hashlib.md5(repr(ends).encode()).hexdigest()}"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps({"file": path, "ends": ends}).encode())
        fs.move(part, note)

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        for split in task.splits:
            yield from self._lines(split)

    def _lines(self, split: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.root)
        name = spark_uri(split.path, self.root)
        with fs.open_input_file(split.path) as file:
            begin = line_start(file, split.at, split.first, split.end)
            stop = split.end if split.until == split.end else line_start(file, split.until, split.first, split.end)
            known = dict(map(tuple, self._noted(split.path)))
            ends, lines = _Ends(), known.get(split.first)
            for block in blocks(file, split.first if lines is not None else 0, begin):
                ends.add(block)
            number, rest = (lines or 0) + ends.lines, b""
            for block in blocks(file, begin, stop):
                cut = block.rfind(b"\n") + 1
                if not cut:
                    rest += block
                    continue
                found, rest = (rest + block[:cut]).splitlines(), block[cut:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(found), pa.string()),
                        pa.array(range(number + 1, number + len(found) + 1), pa.int64()),
                        pa.array([x.decode("utf-8", "replace") for x in found], pa.string()),
                    ],
                    names=["file", "record_key", "value"],
                )
                number += len(found)
            if split.until == split.end:
                before = [[split.first, lines]] if lines is not None else []
                self._write_note(split.path, [*before, [split.end, number]])


def growing_lines(
    spark: SparkSession, folder: str, notes: str, split_bytes: int = SPLIT_BYTES, splits_per_file: int = SPLITS_PER_FILE
) -> DataFrame:
    """Stream of (file, record_key, value): the lines of all files below ``folder`` as they are appended, ``record_key`` being
    the line's number in its file, from 1, and ``file`` what a batch scan calls it.

    ``notes`` is a folder that all executors see, kept as long as the stream's checkpoint. With the trigger
    ``availableNow`` a run takes one trigger's share of each file; run it again while there is progress.
    """
    spark.dataSource.register(GrowingFiles)
    options = {"notes": notes, "split_bytes": str(split_bytes), "splits_per_file": str(splits_per_file)}
    return spark.readStream.format("growing_files").options(**options).load(folder)


__all__ = ["COMPRESSED", "GrowingFiles", "blocks", "file_system", "growing_lines", "line_start", "plain_path", "spark_uri"]
