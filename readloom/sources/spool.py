"""Standard input and pipes: what can be read only once is copied in blocks to the shared folder, and scanned there."""

from __future__ import annotations

import os
import stat
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyspark.sql import SparkSession

from readloom.runtime import shared_folder

BLOCK = 8 << 20


def once(path: str | None) -> bool:
    """Whether a path names standard input, a pipe or a device: something of no known size that can be read once."""
    if path == "-":
        return True
    if not path or "://" in path or not os.path.exists(path):
        return False
    mode = os.stat(path).st_mode
    return not (stat.S_ISREG(mode) or stat.S_ISDIR(mode))


def sized(path: str) -> bool:
    """Whether the number of records may be counted before they are read: of plain files and folders, not of gzip files or streams."""
    return not once(path) and not path.endswith(".gz")


def blocks(stream: BinaryIO) -> Iterator[bytes]:
    while data := stream.read(BLOCK):
        yield data


@contextmanager
def spooled(spark: SparkSession, path: str, stdin: BinaryIO | None = None) -> Iterator[str]:
    """A path to scan instead of ``path``: itself, or a copy in the shared folder, which is deleted at the end.

    The copy keeps gzip as it is. It is written through the file system of the shared folder, a block at a time; blank
    input is an empty file.
    """
    if not once(path):
        yield path
        return
    source = (stdin or sys.stdin.buffer) if path in ("-", "/dev/stdin") else open(path, "rb")  # noqa: SIM115
    folder = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(conf)
    try:
        parts = blocks(source)
        first = next(parts, b"")
        copy = f"{folder}/input{'.gz' if first.startswith(bytes([0x1F, 0x8B])) else ''}"
        out = files.create(jvm.org.apache.hadoop.fs.Path(copy))
        try:
            out.write(bytearray(first))
            for data in parts:
                out.write(bytearray(data))
        finally:
            out.close()
        yield copy
    finally:
        if source is not (stdin or sys.stdin.buffer):
            source.close()
        files.delete(place, True)
