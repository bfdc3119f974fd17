"""Transcript files as rows of complete lines, in batch and as a stream of growing files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MOST_LINE_BYTES = 8 * 1024 * 1024
READ = 1 << 20
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10  # what a task reads, and as how many bytes the opening of a file counts
SCHEMA = "path string, line long, byte_offset long, next_offset long, raw binary"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _linked(base: str, path: str) -> bool:
    """Whether a local path, or a folder between it and the base, is a symbolic link."""
    while len(path) > len(base):
        if os.path.islink(path):
            return True
        path = os.path.dirname(path)
    return False


def listed(root: str, suffix: str = ".jsonl", prefix: str = "") -> list[tuple[str, int, int]]:
    """(path, size, mtime_ns) of regular files below root, by path; links, pipes and what lies behind links are left out."""
    from pyarrow import fs

    system, base = _fs(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    local = system.type_name == "local"
    scheme = root.split("://")[0] + "://" if "://" in root else ""
    fits = lambda f: f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name.startswith(prefix)
    return sorted((scheme + f.path, f.size, f.mtime_ns or 0) for f in found if fits(f) and not (local and _linked(base.rstrip("/"), f.path)))


def discover(root: str, suffix: str = ".jsonl", prefix: str = "") -> list[tuple[str, int]]:
    """(path, size) of regular files below root, by path."""
    return [(path, size) for path, size, _ in listed(root, suffix, prefix)]


# The named roots of transcripts and how their files are named.
ROOTS = {"codex-sessions": ("rollout-", ".jsonl"), "codex-archived": ("rollout-", ".jsonl"), "claude-projects": ("", ".jsonl")}


def discover_roots(folders: dict[str, str]) -> list[tuple[str, str, int]]:
    """(root name, path, size) of the transcripts below the named roots that are given."""
    unknown = set(folders) - set(ROOTS)
    if unknown:
        raise ValueError(f"unknown roots {sorted(unknown)}")
    return [(name, path, size) for name in ROOTS if name in folders for path, size in discover(folders[name], ROOTS[name][1], ROOTS[name][0])]


def complete_lines(path: str, start: int = 0, number: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(number, start, end, raw) of lines that end before `end`; raw is None for an over-long line.

    A tail without a newline is withheld until it is complete. Memory is bounded by the longest line kept.
    """
    system, name = _fs(path)
    with system.open_input_file(name) as f:
        yield from _lines_of(f, start, number, end)


def _lines_of(f, start: int, number: int = 0, end: int | None = None, most: int = READ) -> Iterator[tuple[int, int, int, bytes | None]]:
    """complete_lines of an open file, which is read in blocks of `most` bytes."""
    f.seek(start)
    at, held, size, over = start, [], 0, False
    while end is None or at + size < end:
        block = f.read(most if end is None else min(most, end - at - size))
        if not block:
            return
        pos = 0
        while (nl := block.find(b"\n", pos)) >= 0:
            number += 1
            length = size + nl + 1 - pos
            raw = None if over or length > MOST_LINE_BYTES else b"".join([*held, block[pos:nl]])
            yield number, at, at + length, raw
            at, held, size, over, pos = at + length, [], 0, False, nl + 1
        size += len(block) - pos
        over = over or size > MOST_LINE_BYTES
        held = [] if over else [*held, block[pos:]]


def arrived_lines(path: str, start: int, end: int | None) -> Iterator[tuple[int, int, int, bytes | None]]:
    """As complete_lines, of the lines whose line end lies in [start, end); numbers count from 1. A line that began before start is read whole."""
    begin = 0
    if start:
        system, name = _fs(path)
        with system.open_input_file(name) as f:
            floor, at = max(0, start - MOST_LINE_BYTES - 1), start
            while at > floor:
                size = min(1 << 16, at - floor)
                f.seek(at - size)
                nl = f.read(size).rfind(b"\n")
                if nl >= 0:
                    begin = at - size + nl + 1
                    break
                at -= size
            else:
                begin = floor
    number = 0
    for _, first, after, raw in complete_lines(path, begin, 0, end):
        if after > start:
            number += 1
            yield number, first, after, raw


def tasks(files: int, size: int) -> int:
    """How many tasks read so many files, or ranges of files, of that size in all."""
    return max(1, min(files, 10_000, -(-(size + files * OPEN_BYTES) // TASK_BYTES)))


NAMES, KINDS = ["path", "line", "byte_offset", "next_offset", "raw"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batches(rows, names: list[str] = NAMES, kinds: list[pa.DataType] = KINDS) -> Iterator[pa.RecordBatch]:
    """Rows that end in NAMES, of any number of files, as batches of bounded size."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += row[-2] - row[-3]
        if len(held) >= 5_000 or size > 8 * READ:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@dataclass
class FilePart(InputPartition):
    path: str
    start: int = 0
    number: int = 0
    end: int | None = None


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        o = self.options
        out, size = [Files([])], 0
        for path, more in discover(o["path"], o.get("suffix", ".jsonl"), o.get("prefix", "")):
            if out[-1].paths and size + more + OPEN_BYTES > TASK_BYTES:
                out, size = [*out, Files([])], 0
            out[-1].paths.append(path)
            size += more + OPEN_BYTES
        return out

    def read(self, partition):
        yield from _batches((path, *row) for path in partition.paths for row in complete_lines(path))


class _StreamReader(DataSourceStreamReader):
    """Offsets are {path: bytes} handed out; files may grow and new ones appear. The driver only lists files.

    A range's lines are those whose end arrived in it; their numbers count from the range's start, as
    only a reader of all earlier ranges knows how many lines came before (see streaming.ingest.carried).
    """

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return dict(discover(self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("prefix", "")))

    def partitions(self, start, end):
        return [FilePart(p, start.get(p, 0), end=at) for p, at in sorted(end.items()) if at > start.get(p, 0)]

    def read(self, partition):
        yield from _batches((partition.path, *row) for row in arrived_lines(partition.path, partition.start, partition.end))

    def commit(self, end):
        pass


class TranscriptLines(DataSource):
    """Options: path (a folder), suffix, prefix."""

    @classmethod
    def name(cls):
        return "transcript_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(TranscriptLines)


def _ranges(spark, folder: str, range_bytes: int, suffix: str, prefix: str):
    """(path, start, end) of the ranges of all files below a folder, dealt over tasks by what they read, and the number of tasks."""
    files = discover(folder, suffix, prefix)
    ranges = [(path, start, min(start + range_bytes, size)) for path, size in files for start in range(0, size, range_bytes)]
    n = tasks(len(ranges), sum(size for _, size in files))
    return spark.createDataFrame(ranges, "path string, start long, end long").repartition(n, "path", "start"), n


def numbered(spark, folder: str, range_bytes: int = 128 << 20, suffix: str = ".jsonl", prefix: str = ""):
    """SCHEMA rows of all complete lines below a folder, long files in ranges: line ends are counted range by range, summed up along each file, and the lines read with what came before."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranges, n_tasks = _ranges(spark, folder, range_bytes, suffix, prefix)

    def count(batches):
        for batch in batches:
            n = []
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = _fs(path)
                with system.open_input_file(name) as f:
                    f.seek(start)
                    left, seen = end - start, 0
                    while left and (block := f.read(min(READ, left))):
                        seen, left = seen + block.count(b"\n"), left - len(block)
                n.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["path", "start", "end", "n"])

    def read(batches):
        for batch in batches:
            parts = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield from _batches((path, before + k, a, b, raw) for path, start, end, before in parts for k, a, b, raw in arrived_lines(path, start, end))

    counts = ranges.mapInArrow(count, "path string, start long, end long, n long")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")
    return counts.select("path", "start", "end", before.alias("before")).repartition(n_tasks, "path", "start").mapInArrow(read, SCHEMA)


def journal(text: str) -> list[dict]:
    """Strict JSONL: every line whole, an object, and without repeated keys."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    if text and not text.endswith("\n"):
        raise ValueError("torn line")
    rows = [json.loads(x, object_pairs_hook=unique) for x in text.splitlines()]
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("not an object")
    return rows


def verified(hits, key: str = "id"):
    """(key, intact): whether the bytes at each hit's path and offset still have its digest (columns path, byte_offset, sha256). A file is opened once for hits that follow one another."""
    import hashlib

    def run(batches):
        at, f = None, None
        for batch in batches:
            out = []
            for path, start, sha in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                try:
                    if path != at or f is None:
                        at, f = path, None
                        system, name = _fs(path)
                        f = system.open_input_file(name)
                    raw = next((r for _, _, _, r in _lines_of(f, start, most=1 << 16)), None)
                except OSError:
                    raw = None
                out.append(raw is not None and hashlib.sha256(raw.rstrip(b"\r\n")).hexdigest() == sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], names=[key, "intact"])

    return hits.select(key, "path", "byte_offset", "sha256").mapInArrow(run, f"{key} long, intact boolean")


def holding(spark, folder: str, needles: list[str], range_bytes: int = 128 << 20, suffix: str = "", prefix: str = ""):
    """(path, needle, at) of every place where a file below a folder holds one of at most a few dozen needles, as UTF-8.

    Files are read in ranges, each with as many bytes of the next as the longest needle could reach into it, and in blocks
    within a range, so memory does not depend on the file; an occurrence belongs to the range that it starts in.
    """
    wanted = sorted({n.encode() for n in needles if n})
    ranges, _ = _ranges(spark, folder, range_bytes, suffix, prefix)
    over = max(map(len, wanted), default=1) - 1

    def run(batches):
        for batch in batches:
            out = []
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = _fs(path)
                with system.open_input_file(name) as f:
                    f.seek(start)
                    held, at = b"", start  # held begins at `at`; occurrences that start before the last `over` bytes are whole
                    while True:
                        block = f.read(max(0, min(READ, end + over - at - len(held))))
                        held += block
                        stop = min(len(held) - over, end - at) if block else end - at
                        for needle in wanted:
                            k = held.find(needle)
                            while 0 <= k < stop:
                                out.append((path, needle.decode(), at + k))
                                k = held.find(needle, k + 1)
                        if not block or at + stop >= end:
                            break
                        held, at = held[max(stop, 0) :], at + max(stop, 0)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "needle", "at"])

    return ranges.mapInArrow(run, "path string, needle string, at long")


def heartbeat(path: str, most_bytes: int = 16_384) -> dict:
    """A small JSON status object; {} if it is missing, too large or no object."""
    system, name = _fs(path)
    try:
        with system.open_input_file(name) as f:
            value = json.loads(f.read()) if f.size() <= most_bytes else {}
    except (OSError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}
