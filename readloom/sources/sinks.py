"""Writers of text in order, and the checks of paths that come before any work."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def write_text(rows: DataFrame, path: str, order: str = "ord", text: str = "text", one_file: bool = False, sort: bool = True) -> None:
    """``rows`` in ``order`` as a folder of text files whose names sort as their rows do; gzip if the path ends in .gz.

    ``one_file`` writes a single part, for results small enough for one task. Without ``sort`` the rows are in order, as
    those of a scan are through read-by-read steps: nothing is shuffled.
    """
    done = (rows.orderBy(order) if sort else rows).select(text)
    (done.coalesce(1) if one_file else done).write.option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def write_file(rows: DataFrame, path: str, order: str = "ord", text: str = "text", sort: bool = True) -> None:
    """``rows`` in ``order`` as one file, gzip if the path ends in .gz; an existing file is replaced when all is written.

    Tasks write parts beside the file; the file system then joins them, in order, without decoding them: gzip members may
    follow one another. No task holds all rows. ``sort`` says that rows are not in order yet.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    aside = f"{path}.parts-{uuid.uuid4().hex}"
    files = fs.Path(path).getFileSystem(conf)
    try:
        write_text(rows, f"{aside}{'.gz' if path.endswith('.gz') else ''}", order, text, sort=sort)
        folder = fs.Path(f"{aside}{'.gz' if path.endswith('.gz') else ''}")
        parts = sorted((str(f.getPath()) for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.rsplit("/", 1)[1])
        joined = fs.Path(f"{aside}.joined")
        out = files.create(joined)
        try:
            for part in parts:
                source = files.open(fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
        finally:
            out.close()
        replace(spark, f"{aside}.joined", path)
    finally:
        for name in (f"{aside}.gz", aside, f"{aside}.joined"):
            delete(spark, name)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another one, in one step where the file system can."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    files = fs.Path(target).getFileSystem(conf)
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    uri = files.makeQualified(fs.Path(target)).toUri()
    fs.FileContext.getFileContext(uri, conf).rename(files.makeQualified(fs.Path(source)), files.makeQualified(fs.Path(target)), over)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def print_text(rows: DataFrame, order: str = "ord", text: str = "text", out=None) -> None:
    """``rows`` in ``order`` on standard output, a partition at a time."""
    for row in rows.orderBy(order).select(text).toLocalIterator():
        print(row[0], file=out or sys.stdout)


def check_paths(inputs: Iterable[str | None], outputs: Iterable[str | None]) -> None:
    """Outputs differ from one another and from all inputs, links followed; devices don't count, and an input may repeat."""
    real = lambda paths: [os.path.realpath(p) if "://" not in p else p.rstrip("/") for p in paths if p and not p.startswith("/dev/")]
    read, written = real(inputs), real(outputs)
    if both := set(read) & set(written):
        raise ValueError(f"read and written: {', '.join(sorted(both))}")
    if len(written) != len(set(written)):
        raise ValueError("two outputs have one path")
