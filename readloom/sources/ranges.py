"""Byte ranges of text files as partitions that begin and end at records: plain files, and gzip files of many members.

A range owns the lines that follow a line end inside of it (the first range of a file also the file's first line), and a
record belongs to the range that owns its first line. So each range finds its first record by itself, reads on past its
end until its last record is whole, and no line is numbered, shuffled or read by two tasks. A gzip file is cut where
members begin: a range finds the first member that begins in it by its magic bytes and by inflating it. A file of one
member stays one range's work. Executors open the files themselves, so this reader is for paths that all of them see;
``openable`` tells, and other stores are read by Spark's own reader.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.runtime import durable

#: Bytes of a range, on disk, and bytes that are read or inflated at a time.
RANGE_BYTES, CHUNK = 64 << 20, 4 << 20
#: Bytes that have to inflate before a place counts as a member's begin; its checksum is verified when it is read anyway.
PROBE = 1 << 20
#: gzip's magic and method, no reserved flag, the levels' and systems' codes.
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f].{4}[\x00\x02\x04][\x00-\x0d\xff]", re.DOTALL)
LONGEST_MAGIC = 10
#: Ranges whose first numbers are broadcast, else joined.
BROADCAST_RANGES = 100_000
SCHEMAS = {"lines": "part int, nth bigint, value string", "fastq": "part int, nth bigint, header string, sequence string, quality string"}
#: A number is the range's number and the place in it.
PART_SHIFT = 40


def local_path(path: str) -> str | None:
    """The path as the operating system knows it, or none if it names another store."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        return None
    return unquote(found.path) if found.scheme else path


def openable(path: str) -> bool:
    own = local_path(path)
    return own is not None and os.path.exists(own)


def files_of(path: str) -> list[str]:
    own = local_path(path)
    if not os.path.isdir(own):
        return [own]
    return sorted(f.path for f in os.scandir(own) if f.is_file() and not f.name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    part: int
    path: str
    start: int
    end: int


class RangeSource(DataSource):
    """``spark.read.format("record_ranges").option("kind", "fastq").option("rangeBytes", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "record_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "lines")]

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.kind = options["path"], options.get("kind", "lines")
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        cuts = [(f, s, min(s + self.bytes, os.path.getsize(f))) for f in files_of(self.path) for s in range(0, os.path.getsize(f), self.bytes)]
        return [Range(i, *cut) for i, cut in enumerate(cuts)]

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        rows = fastq_records(own) if self.kind == "fastq" else owned_lines(own)
        n = 0
        for columns in rows:
            size = len(columns[0])
            if size:
                head = [pa.array([own.part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64())]
                names = [c.split(" ")[0] for c in SCHEMAS[self.kind].split(", ")]
                yield pa.record_batch([*head, *(pa.array([x.decode("utf-8", "replace") for x in c], pa.string()) for c in columns)], names=names)
                n += size


def chunks(own: Range) -> Iterator[tuple[bool, bytes]]:
    """(whether it is the range's, text) in order: the range's text, and on request what follows it in the file."""
    with open(own.path, "rb") as f:
        if f.read(2) == b"\x1f\x8b":
            yield from members(f, own)
            return
        f.seek(own.start)
        left = own.end - own.start
        while left and (data := f.read(min(CHUNK, left))):
            left -= len(data)
            yield True, data
        while data := f.read(CHUNK):
            yield False, data


def members(f, own: Range) -> Iterator[tuple[bool, bytes]]:
    start = 0 if own.start == 0 else first_member(f, own)
    while start is not None:
        mine, inflate = start < own.end, zlib.decompressobj(31)
        f.seek(start)
        while not inflate.eof:
            data = inflate.unconsumed_tail or f.read(CHUNK)
            if not data:
                raise EOFError(f"{own.path}: the last gzip member is cut short")
            text = inflate.decompress(data, CHUNK)
            if text:
                yield mine, text
        start = next_member(f, f.tell() - len(inflate.unused_data), own.path)


def next_member(f, at: int, path: str) -> int | None:
    """Where the member after a member's end ``at`` begins; zeros may pad the file."""
    f.seek(at)
    while data := f.read(CHUNK):
        rest = data.lstrip(b"\0")
        if rest:
            if not (rest + f.read(2)).startswith(b"\x1f\x8b"):
                raise ValueError(f"{path}: no gzip member at byte {at + len(data) - len(rest)}")
            return at + len(data) - len(rest)
        at += len(data)
    return None


def first_member(f, own: Range) -> int | None:
    """Where the first member that begins in the range begins."""
    at = own.start
    while at < own.end:
        f.seek(at)
        data = f.read(CHUNK + LONGEST_MAGIC)
        for found in MEMBER.finditer(data):
            if found.start() >= CHUNK or at + found.start() >= own.end:
                break
            if inflates(f, at + found.start()):
                return at + found.start()
        at += CHUNK
    return None


def inflates(f, at: int) -> bool:
    """Whether a member begins here: PROBE bytes of text inflate, or all of it with the right checksum."""
    f.seek(at)
    inflate, size = zlib.decompressobj(31), 0
    try:
        while not inflate.eof and size < PROBE:
            data = inflate.unconsumed_tail or f.read(1 << 16)
            if not data:
                return False
            size += len(inflate.decompress(data, PROBE))
    except zlib.error:
        return False
    return True


class Lines:
    """The lines of a range: those that it owns, and then, one by one, those behind them."""

    def __init__(self, own: Range) -> None:
        self.source, self.own = chunks(own), own
        self.behind: bytes | None = None  # text behind the range that has been read
        self.ended = False

    def owned(self) -> Iterator[list[bytes]]:
        rest, skip = b"", self.own.start > 0
        for mine, data in self.source:
            if not mine:
                self.behind = data
                break
            *lines, rest = (rest + data).split(b"\n")
            if skip and lines:
                lines, skip = lines[1:], False  # the range before this one owns it
            yield [x.removesuffix(b"\r") for x in lines]
        if not skip:
            self.behind = rest + (self.behind or b"")
            yield self.more(1)

    def more(self, n: int) -> list[bytes]:
        out = []
        while len(out) < n and not (self.ended and not self.behind):
            line, end, rest = (self.behind or b"").partition(b"\n")
            if not end and not self.ended:
                data = next(self.source, (False, b""))[1]
                self.ended = not data
                self.behind = (self.behind or b"") + data
                continue
            self.behind = rest
            if line or end:
                out.append(line.removesuffix(b"\r"))
        return out


def owned_lines(own: Range) -> Iterator[list[list[bytes]]]:
    for lines in Lines(own).owned():
        yield [lines]


def fastq_records(own: Range) -> Iterator[list[list[bytes]]]:
    """Columns of headers, sequences and qualities of the four-line records that begin in the range."""
    lines, held, found, nth = Lines(own), [], own.start == 0, 0
    for some in lines.owned():
        held += some
        if not found and len(held) >= 7:
            held, found = held[first_record(held, own) :], True
        if found and own.start == 0 and nth == 0:
            held = held[next((i for i, x in enumerate(held) if x.strip()), len(held)) :]  # a file may begin with blank lines
        whole = len(held) // 4 * 4 if found else 0
        if whole:
            yield columns_of(held[:whole], own, nth)
            nth += whole // 4
            held = held[whole:]
    owned = len(held)
    if not found:
        held += lines.more(7 - owned) if owned else []
        at = first_record(held, own)
        held, owned = held[at:], owned - at
    end = -(-max(owned, 0) // 4) * 4
    held += lines.more(end - len(held))
    if any(x.strip() for x in held[:end]):  # blank lines may end the file
        yield columns_of(held[:end], own, nth)
        nth += end // 4
    if nth:  # a record that is cut short begins in no range, so the record before it tells
        behind = [*held[end:], *lines.more(end + 4 - len(held))]
        if any(x.strip() for x in behind) and not (len(behind) >= 4 and behind[0].startswith(b"@")):
            raise ValueError(f"{own.path}: bad FASTQ record {nth} of the range from byte {own.start}")


def first_record(lines: list[bytes], own: Range) -> int:
    """The first of up to four lines at which a record begins: a quality line may begin with @ too, but then the line after the next is a sequence."""
    for i in range(min(4, len(lines))):
        if lines[i].startswith(b"@") and i + 2 < len(lines) and lines[i + 2].startswith(b"+"):
            return i
    if len(lines) >= 7 and any(lines):
        raise ValueError(f"{own.path}: bad FASTQ record near byte {own.start}")
    return len(lines)


def columns_of(lines: list[bytes], own: Range, nth: int) -> list[list[bytes]]:
    while lines and (not lines[-1].strip() if len(lines) % 4 else not any(x.strip() for x in lines[-4:])):
        lines = lines[: -(len(lines) % 4 and 1 or 4)]
    header, sequence, plus, quality = (lines[i::4] for i in range(4))
    for i, (h, s, p) in enumerate(zip(header, sequence, plus)):
        if i >= len(quality) or not h.startswith(b"@") or not p.startswith(b"+") or len(s.decode("utf-8", "replace")) != len(quality[i].decode("utf-8", "replace")):
            raise ValueError(f"{own.path}: bad FASTQ record {nth + i} of the range from byte {own.start}")
    if len(header) != len(quality):
        raise ValueError(f"{own.path}: bad FASTQ record {nth + len(quality)} of the range from byte {own.start}")
    return [[h[1:] for h in header], sequence, quality]


def ranges(spark: SparkSession, path: str, kind: str, range_bytes: int | None = None) -> DataFrame:
    """The rows of SCHEMAS[kind]: the range's number, the row's place in it, and the line or record."""
    spark.dataSource.register(RangeSource)
    return spark.read.format(RangeSource.name()).option("kind", kind).option("path", path).option("rangeBytes", range_bytes or RANGE_BYTES).load()


def placed(rows: DataFrame, name: str = "ord") -> DataFrame:
    """``rows`` with a number that ascends in the file's order, with gaps; nothing is counted for it."""
    return rows.select((F.shiftleft(F.col("part").cast("long"), PART_SHIFT) + F.col("nth")).alias(name), *(c for c in rows.columns if c not in ("part", "nth")))


def counted(rows: DataFrame, name: str = "ord") -> DataFrame:
    """``rows`` with 0, 1, 2, ... in the file's order: ranges are read once more before, to be counted."""
    sizes = durable(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    known = rows.join(F.broadcast(starts) if sizes.count() <= BROADCAST_RANGES else starts, "part")
    return known.select((F.col("before") + F.col("nth")).alias(name), *(c for c in rows.columns if c not in ("part", "nth")))
