"""Media columns: signatures found by Aho-Corasick, structures and lengths confirmed, types corrected, media carved."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Magic bytes, how far into the file they stand, and the type they point to.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"OggS", 0, "application/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
BMP_HEADERS = {12, 40, 52, 56, 64, 108, 124}
UNIT = 192
RATE = 8000


def png_end(d: bytes, at: int) -> int | None:
    """Chunks with right checksums, IHDR first, up to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, i)
        end = i + 12 + n
        if end > len(d) or first and (kind, n) != (b"IHDR", 13) or zlib.crc32(d[i + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        i, first = end, False
    return None


def jpeg_end(d: bytes, at: int) -> int | None:
    """Segments up to a scan, then entropy-coded bytes up to the end marker."""
    i, scanned = at + 2, False
    while i + 4 <= len(d) or scanned and i + 2 <= len(d):
        if d[i] != 0xFF:
            return None
        marker = d[i + 1]
        if marker == 0xD9:
            return i + 2 if scanned else None
        if marker == 0xFF:
            i += 1
            continue
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8 or i + 4 > len(d):
            return None
        n = struct.unpack_from(">H", d, i + 2)[0]
        if n < 2:
            return None
        i += 2 + n
        if marker == 0xDA:
            scanned = True
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return None


def gif_end(d: bytes, at: int) -> int | None:
    """Screen, colour tables and blocks up to the trailer."""

    def after_blocks(i: int) -> int:
        while i < len(d) and d[i]:
            i += d[i] + 1
        return i + 1

    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    pictures = 0
    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 if pictures else None
        if d[i] == 0x21:
            i = after_blocks(i + 2)
        elif d[i] == 0x2C and i + 10 < len(d):
            flags = d[i + 9]
            i = after_blocks(i + 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1)
            pictures += 1
        else:
            return None
    return None


def bmp_end(d: bytes, at: int) -> int | None:
    """Size, reserved zeros, offset of the pixels, and a header of a known length with one plane."""
    if at + 30 > len(d):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", d, at + 2)
    planes = struct.unpack_from("<H", d, at + (22 if header == 12 else 26))[0]
    return at + size if not reserved and header in BMP_HEADERS and planes == 1 and 14 + header <= pixels <= size <= len(d) - at else None


def riff_chunks(d: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """First chunk of each name as (start, end), if all chunks fill the file exactly."""
    if at + 12 > len(d):
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d) or end < at + 12:
        return None
    found, i = {}, at + 12
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, i)
        if i + 8 + n > end:
            return None
        found.setdefault(name, (i + 8, i + 8 + n))
        i += 8 + n + n % 2
    return found if i >= end else None


def riff_end(d: bytes, at: int) -> tuple[str, int] | None:
    kind, chunks = RIFF_TYPES.get(d[at + 8 : at + 12]), riff_chunks(d, at)
    if not kind or chunks is None or kind == "audio/wav" and not {b"fmt ", b"data"} <= set(chunks):
        return None
    return kind, at + 8 + struct.unpack_from("<I", d, at + 4)[0]


def ogg_end(d: bytes, at: int) -> tuple[int | None, int]:
    """Pages in a row, up to the last that is whole; twice."""
    i, end = at, None
    while d[i : i + 4] == b"OggS" and i + 27 <= len(d) and d[i + 4] == 0:
        table = d[i + 27 : i + 27 + d[i + 26]]
        i += 27 + len(table) + sum(table)
        if i > len(d) or len(table) == 0:
            break
        end = i
    return end, end or at


def flac_end(d: bytes, at: int) -> int | None:
    """Metadata blocks, STREAMINFO first; the frames are the rest of the bytes."""
    i, first = at + 4, True
    while i + 4 <= len(d):
        kind, n = d[i], int.from_bytes(d[i + 1 : i + 4], "big")
        if first and (kind & 0x7F, n) != (0, 34) or i + 4 + n > len(d):
            return None
        i, first = i + 4 + n, False
        if kind & 0x80:
            return len(d)
    return None


def mp4_end(d: bytes, at: int) -> tuple[int | None, int]:
    """Boxes with printable names in a row, moov or mdat among them; and up to where they go in any case."""
    i, names = at, set()
    while i + 8 <= len(d):
        n, name = struct.unpack_from(">I4s", d, i)
        if n == 1 and i + 16 <= len(d):
            n = struct.unpack_from(">Q", d, i + 8)[0]
        if n < 8 or i + n > len(d) or not all(32 <= c < 127 for c in name):
            break
        names.add(name)
        i += n
    return i if names & {b"moov", b"mdat"} else None, i


class Marks:
    """What is looked up once for all signatures of some bytes, so that many of them cost no more than a few."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        #: per kind, up to where the last medium reaches that was found: a begin inside of it is a part of it
        self.until: dict[str, int] = {}

    @cached_property
    def pdf(self) -> tuple[int, int]:
        """The last trailer, and the last reference to a table before it."""
        end = self.data.rfind(b"%%EOF")
        return end, self.data.rfind(b"startxref", 0, max(0, end))

    @cached_property
    def zips(self) -> dict[int, int]:
        """begin -> end of each archive that an end record tells of; the central directory stands right before that record."""
        found, i = {}, self.data.find(b"PK\x05\x06")
        while i >= 0 and i + 22 <= len(self.data):
            size, offset, comment = struct.unpack_from("<IIH", self.data, i + 12)
            if i + 22 + comment <= len(self.data):
                found.setdefault(i - offset - size, i + 22 + comment)
            i = self.data.find(b"PK\x05\x06", i + 4)
        return found


def pdf_end(marks: Marks, at: int) -> int | None:
    end, table = marks.pdf
    return end + 5 if marks.data[at + 5 : at + 6].isdigit() and at <= table < end else None


def zip_end(marks: Marks, at: int) -> int | None:
    return marks.zips.get(at)


def once(kind: str, end_of: Callable[[bytes, int], tuple[int | None, int]]) -> Callable[[Marks, int], int | None]:
    """The end of a medium that is a row of parts which each begin like one: begins inside what was walked are none."""

    def end(marks: Marks, at: int) -> int | None:
        if at < marks.until.get(kind, 0):
            return None
        found, marks.until[kind] = end_of(marks.data, at)
        return found

    return end


def gzip_end(d: bytes, at: int) -> int | None:
    stream, i = zlib.decompressobj(31), at
    try:
        while not stream.eof and i < len(d):
            rest = stream.decompress(d[i : i + 65536], 1 << 20)
            while stream.unconsumed_tail:
                rest = stream.decompress(stream.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return None
    del rest
    return min(i, len(d)) - len(stream.unused_data) if stream.eof else None


ENDS = {"image/png": png_end, "image/jpeg": jpeg_end, "image/gif": gif_end, "image/bmp": bmp_end, "audio/flac": flac_end, "application/gzip": gzip_end}
MARKED_ENDS = {"application/ogg": once("application/ogg", ogg_end), "video/mp4": once("video/mp4", mp4_end), "application/pdf": pdf_end, "application/zip": zip_end}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, before, kind in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic) + before, kind))
    out.make_automaton()
    return out


def confirmed(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every medium in ``data``, by start; a signature without a right structure is none."""
    found, marks = [], Marks(data)
    for last, (back, kind) in automaton().iter(data.decode("latin-1")):
        start = last + 1 - back
        if start < 0:
            continue
        if kind == "riff":
            if got := riff_end(data, start):
                found.append((start, got[1], got[0]))
        elif (end := MARKED_ENDS[kind](marks, start) if kind in MARKED_ENDS else ENDS[kind](data, start)) is not None:
            found.append((start, end, kind))
    return sorted(set(found))


SNIFFED = "struct<type:string,declared_right:boolean,length:bigint,embedded:array<struct<type:string,start:bigint,length:bigint>>>"


def sniff(df: DataFrame, data: str = "data", declared: str = "declared_type", name: str = "media") -> DataFrame:
    """``df`` with a struct ``name`` for each binary value of ``data``.

    type is the confirmed type of the medium that starts the bytes (null if none: then the declared type is wrong or
    the bytes are cut), declared_right whether ``declared`` says so, length the medium's own length, embedded the
    media that start further on, with offsets to carve them by. Null bytes give a null struct, empty ones a null type.
    """
    common.bounded_batches(df.sparkSession)

    @arrow_udf(SNIFFED)
    def sniffed(values: pa.Array, declared: pa.Array) -> pa.Array:
        out = []
        for value, said in zip(values, declared):
            if not value.is_valid:
                out.append(None)
                continue
            found = confirmed(value.as_py())
            kind, end = next(((k, e) for s, e, k in found if s == 0), (None, None))
            inside = [{"type": k, "start": s, "length": e - s} for s, e, k in found if s]
            out.append({"type": kind, "declared_right": kind is not None and kind == said.as_py(), "length": end, "embedded": inside})
        inner = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        return pa.array(out, pa.struct([("type", pa.string()), ("declared_right", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(inner))]))

    return df.withColumn(common.fresh(df, name)[0], sniffed(F.col(data), F.col(declared)))


def carve(df: DataFrame, data: str = "data", media: str = "media") -> DataFrame:
    """One row per embedded medium: the columns of ``df`` but ``data`` and ``media``, then type, start and its bytes."""
    rest = [c for c in df.columns if c not in (data, media)]
    one, whole, kind, start, content = common.fresh(df, "_one", "_data", "carved_type", "carved_start", "carved")
    every = df.select(*(F.col(f"`{c}`") for c in rest), F.col(data).alias(whole), F.explode(f"{media}.embedded").alias(one))
    return every.select(*(F.col(f"`{c}`") for c in rest), F.col(f"{one}.type").alias(kind), F.col(f"{one}.start").alias(start), cut_out(whole, one).alias(content))


def cut_out(data: str, one: str) -> Column:
    return F.expr(f"substring(`{data}`, cast({one}.start + 1 as int), cast({one}.length as int))")


def wav(payload: bytes) -> bytes:
    """A one-channel file of unsigned 8-bit samples."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def stored(text: Column) -> Column:
    """Each text as UTF-8 with spaces up to a positive multiple of UNIT, stored as audio samples."""

    @arrow_udf("binary")
    def put(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            data = value.as_py().encode("utf-8")
            out.append(wav(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")))
        return pa.array(out, pa.binary())

    return put(text)


READ = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def read_back(data: Column, kind: Column) -> Column:
    """What stored bytes of the sniffed type ``kind`` hold: the samples are found by the file's own structure and measured."""

    @arrow_udf(READ)
    def got(values: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = []
        for value, kind in zip(values, kinds.to_pylist()):
            data = value.as_py()
            if kind != "audio/wav":
                raise ValueError(f"stored bytes read back as {kind}")
            start, stop = riff_chunks(data, 0)[b"data"]
            samples = np.frombuffer(data, "u1", stop - start, start)
            payload = samples.tobytes()
            level = samples.astype("f8") - 128
            feature = f"{kind};samples={len(samples)};mean={level.mean():.3f};rms={np.sqrt((level * level).mean()):.3f};peak={int(np.abs(level).max())}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names)

    return got(data, kind)


#: What the query declares its stored texts to be, by a hash of the text: one of these is right.
DECLARED = ["image/png", "audio/wav", "application/pdf", "image/gif", "audio/flac"]


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the declared and the corrected type, and the media carved out of the stored bytes."""
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_of("text").alias("text"))
    declared = F.element_at(F.array(*map(F.lit, DECLARED)), (F.pmod(F.xxhash64("text"), F.lit(len(DECLARED))) + 1).cast("int"))
    put = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), declared.alias("declared_type"), stored(F.col("text")).alias("data"))
    out = sniff(put).withColumn("m", read_back(F.col("data"), F.col("media.type")))
    carved = F.expr("transform(media.embedded, e -> struct(e.type, e.start, e.length, sha2(substring(data, cast(e.start + 1 as int), cast(e.length as int)), 256) as sha256))")
    return out.select("doc_id", "n_bytes", "m.*", "declared_type", F.col("media.type").alias("media_type"), "media.declared_right", carved.alias("embedded"))
