"""News archives as a Python data source: a zip file or a folder with an exact set of members.

``news_archive`` gives a row for each line: (member, at, value, history, candidates), where
``at`` is the byte at which the line begins and the last two count the tokens of a
behaviours line (null for other members and for lines without five cells, which the parser
refuses).  Lines are checked as they are read, and what is refused is named by member and
byte: a line over ``max_line_bytes``, more than ``max_candidates`` candidates, a carriage
return inside a line, bytes that are not UTF-8.  Blank lines are left out.

Splits: plain files and stored members are cut into ranges of ``split_bytes``, and a range
has the lines that begin in it; a deflated member is a stream, so it is one split.  Neither
the driver nor a task holds more than a batch of lines.  ``archive_digests`` streams each
member once and gives (member, bytes, sha256).

Python opens the path in the tasks, so it must be in a folder that all executors share.
Totals over an archive are ceilings of the job that writes it: see ``ceilings``.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import readers

MEMBERS = ("train/news.tsv", "train/behaviors.tsv", "dev/news.tsv", "dev/behaviors.tsv")
LINES = "member string, at long, value string, history int, candidates int"
DIGESTS = "member string, bytes long, sha256 string"
_LINES = pa.schema([("member", pa.string()), ("at", pa.int64()), ("value", pa.string()), ("history", pa.int32()), ("candidates", pa.int32())])
BATCH, BLOCK = 4096, 1 << 20


class Refused(ValueError):
    """An archive or a line that the source does not take."""


@dataclass
class Split(InputPartition):
    member: str
    begin: int
    end: int
    size: int
    #: Where a stored member's bytes begin in the zip file; -1 for a stream or a plain file.
    base: int = -1


def _stored_at(path: str, info: zipfile.ZipInfo) -> int:
    """The first byte of a member's data: its local header has lengths of its own."""
    with open(path, "rb") as f:
        f.seek(info.header_offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise Refused(f"{info.filename}: no local header")
        return info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def plan(path: str, members: tuple[str, ...], split_bytes: int, max_bytes: int) -> list[Split]:
    """Splits of an archive whose members are exactly those named."""
    out: list[Split] = []
    ranges = lambda name, size, base: [Split(name, a, min(a + split_bytes, size), size, base) for a in range(0, size, split_bytes)]
    if os.path.isdir(path):
        there = {os.path.relpath(os.path.join(folder, f), path).replace(os.sep, "/") for folder, _, files in os.walk(path) for f in files}
        _exact(there, members)
        for name in members:
            size = os.path.getsize(os.path.join(path, name))
            _small(name, size, max_bytes)
            out += ranges(name, size, -1)
        return out
    with zipfile.ZipFile(path) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
        names = [i.filename for i in infos]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise Refused(f"members occur twice: {', '.join(twice)}")
        _exact(set(names), members)
        for info in sorted(infos, key=lambda i: members.index(i.filename)):
            _small(info.filename, info.file_size, max_bytes)
            if info.flag_bits & 1:
                raise Refused(f"{info.filename} is encrypted")
            if info.compress_type == zipfile.ZIP_STORED:
                out += ranges(info.filename, info.file_size, _stored_at(path, info))
            elif info.file_size:
                out.append(Split(info.filename, 0, info.file_size, info.file_size))
    return out


def _exact(there: set[str], members: tuple[str, ...]) -> None:
    if missing := sorted(set(members) - there):
        raise Refused(f"members are missing: {', '.join(missing)}")
    if extra := sorted(there - set(members)):
        raise Refused(f"members that are not of the archive: {', '.join(extra)}")


def _small(name: str, size: int, most: int) -> None:
    if size > most:
        raise Refused(f"{name} has {size} bytes, over the limit of {most}")


def _opened(path: str, split: Split) -> BinaryIO:
    if os.path.isdir(path):
        return open(os.path.join(path, split.member), "rb")
    return open(path, "rb") if split.base >= 0 else zipfile.ZipFile(path).open(split.member)  # type: ignore[return-value]


def lines(path: str, split: Split, longest: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line with its end) of the lines that begin in a split."""
    base = max(split.base, 0)
    with _opened(path, split) as f:
        at = split.begin
        if at:  # the line before may end with the byte before
            f.seek(base + at - 1)
            at -= 1
            while piece := f.readline(BLOCK):
                at += len(piece)
                if piece.endswith(b"\n"):
                    break
        elif base:
            f.seek(base)
        # The line that begins last may end in another split, but not behind the member, where
        # a zip file goes on.
        while at < split.end and (line := f.readline(min(longest + 3, split.size - at))):
            if len(line.rstrip(b"\r\n")) > longest:
                raise Refused(f"{split.member}, byte {at}: a line of over {longest} bytes")
            yield at, line
            at += len(line)


class _Lines(DataSourceReader):
    def __init__(self, options):
        self.path, self.members, self.split_bytes, self.max_bytes = _common(options)
        self.longest, self.most = int(options.get("max_line_bytes", 1 << 20)), int(options.get("max_candidates", 1000))

    def partitions(self):
        # An archive without a byte still has one (empty) split.
        return plan(self.path, self.members, self.split_bytes, self.max_bytes) or [Split(self.members[0], 0, 0, 0)]

    def read(self, split):
        shown = split.member.endswith("behaviors.tsv")
        rows: list[tuple] = []
        for at, line in lines(self.path, split, self.longest):
            body = line.rstrip(b"\n").rstrip(b"\r")
            if b"\r" in body:
                raise Refused(f"{split.member}, byte {at}: a carriage return inside a line")
            try:
                text = body.decode()
            except UnicodeDecodeError as error:
                raise Refused(f"{split.member}, byte {at + error.start}: not UTF-8") from None
            if not text.strip():
                continue
            history = candidates = None
            if shown and len(cells := text.split("\t")) == 5:
                history, candidates = len(cells[3].split()), len(cells[4].split())
                if candidates > self.most:
                    raise Refused(f"{split.member}, byte {at}: {candidates} candidates, over the limit of {self.most}")
            rows.append((split.member, at, text, history, candidates))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


class _Digests(DataSourceReader):
    def __init__(self, options):
        self.path, self.members, _, self.max_bytes = _common(options)

    def partitions(self):
        plan(self.path, self.members, 1 << 62, self.max_bytes)
        return [Split(m, 0, 0, 0) for m in self.members]

    def read(self, split):
        digest, n = hashlib.sha256(), 0
        with _opened(self.path, split) as f:
            while block := f.read(BLOCK):
                digest.update(block)
                n += len(block)
        yield split.member, n, digest.hexdigest()


def _common(options) -> tuple[str, tuple[str, ...], int, int]:
    path = options.get("path")
    if not path:
        raise Refused("a news archive needs a path")
    split_bytes = int(options.get("split_bytes", 64 << 20))
    if split_bytes < 1:
        raise Refused("split_bytes must be positive")
    return path, tuple(options.get("members", ",".join(MEMBERS)).split(",")), split_bytes, int(options.get("max_bytes", 1 << 40))


class NewsArchive(DataSource):
    @classmethod
    def name(cls):
        return "news_archive"

    def schema(self):
        return LINES

    def reader(self, schema):
        return _Lines(self.options)


class ArchiveDigests(DataSource):
    @classmethod
    def name(cls):
        return "archive_digests"

    def schema(self):
        return DIGESTS

    def reader(self, schema):
        return _Digests(self.options)


def _read(spark: SparkSession, source: type[DataSource], path: str, options: dict) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def archive(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The lines of an archive; options as in the module's docstring."""
    return _read(spark, NewsArchive, path, options)


def digests(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _read(spark, ArchiveDigests, path, options)


def articles(spark: SparkSession, made: DataFrame, member: str, published_us: int) -> DataFrame:
    """Articles of one member of ``archive``'s lines."""
    return readers.news_tsv(spark, made.where(F.col("member") == member).select("value"), published_us)


def impressions(spark: SparkSession, made: DataFrame, member: str, offset: str = "+00:00") -> DataFrame:
    return readers.behaviors_tsv(spark, made.where(F.col("member") == member).select("value"), offset)


def summary(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """For each member: lines, ignored history items (they have no time, so they are no
    events), candidates, bytes and digest.  Partial counts are summed; no line is moved."""
    counts = archive(spark, path, **options).groupBy("member").agg(F.count("*").alias("lines"), F.coalesce(F.sum("history"), F.lit(0)).alias("ignored_history"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
    none = {c: 0 for c in ("lines", "ignored_history", "candidates")}
    return digests(spark, path, **{k: v for k, v in options.items() if k in ("members", "max_bytes")}).join(counts, "member", "left").fillna(none).select("member", *none, "bytes", "sha256")
