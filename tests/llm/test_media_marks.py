"""Many signatures in one value, and media made of parts that each begin like one."""

import gzip
import io
import struct
import time
import zipfile

from readloom.llm import media


def ogg_page(number, data, flags=0):
    table = bytes([255] * (len(data) // 255) + [len(data) % 255])
    return b"OggS\0" + bytes([flags]) + struct.pack("<QIII", number, 1, number, 0) + bytes([len(table)]) + table + data


def test_a_stream_of_a_thousand_pages_is_one_medium():
    stream = b"".join(ogg_page(i, bytes([i % 251]) * (i % 400)) for i in range(1000))
    assert media.confirmed(b"lead" + stream + b"tail") == [(4, 4 + len(stream), "application/ogg")]
    assert media.confirmed(stream + b"--" + ogg_page(0, b"x")) == [(0, len(stream), "application/ogg"), (len(stream) + 2, len(stream) + 2 + 29, "application/ogg")]


def test_movies_and_archives_among_others():
    box = lambda name, data=b"": struct.pack(">I4s", 8 + len(data), name) + data
    movie = box(b"ftyp", b"isom") + box(b"moov", b"12345678") + box(b"ftyp", b"again") + box(b"mdat", b"x" * 50)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a", "one")
        z.writestr("b", "two")
    archive = data.getvalue()
    pdf = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF"
    found = media.confirmed(movie + b"\0\0\0\0" + archive + b"@@" + archive + pdf + gzip.compress(b"z"))
    assert [(k, e - s) for s, e, k in found] == [("video/mp4", len(movie)), ("application/zip", len(archive)), ("application/zip", len(archive)), ("application/pdf", len(pdf)), ("application/gzip", len(gzip.compress(b"z")))]


def test_ten_megabytes_of_signatures_take_seconds():
    for magic in (b"%PDF-1 ", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + bytes(18), b"\0\0\0\x08ftyp", b"OggS", b"\xff\xd8\xff", b"RIFF", b"fLaC"):
        data = magic * ((10 << 20) // len(magic))
        began = time.perf_counter()
        found = media.confirmed(data)
        assert len(found) < 3 or magic.startswith(b"PK"), magic
        assert time.perf_counter() - began < 25, magic
