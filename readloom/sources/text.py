"""Numbered lines and records of text files of any size: no file, and no record, is brought to one task for it.

Spark's own reader splits plain files and decodes .gz ones (several members in one file too), from any store it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import ranges

#: Splits of one scan whose first numbers are broadcast: at 128 MB a split, this is a scan of 128 TB.
MOST_SPLITS = 1 << 20


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, split, value): the pieces of a file between separators (line ends if none is given)."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def first_numbers(pieces: DataFrame) -> dict[tuple[str, int], int]:
    """(file, split) -> how many pieces come before it, files in the order of their names."""
    sizes = pieces.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.orderBy("file", "split").limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"over {MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    out, total = {}, 0
    for r in rows:
        out[r["file"], r["split"]] = total
        total += r["n"]
    return out


def numbered(spark: SparkSession, path: str, separator: str | None = None, blank: bool = True) -> DataFrame:
    """(n, value): pieces with their number in the whole input; counted once, then numbered where they are read.

    Without ``blank`` pieces of white space alone are left out and not counted.
    """
    pieces = lines(spark, path, separator)
    if not blank:
        pieces = pieces.where(r"value rlike '\\S'")
    start = spark.sparkContext.broadcast(first_numbers(pieces))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            out = []
            for where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if where != at:
                    at, n = where, start.value[where]
                out.append(n)
                n += 1
            yield pa.record_batch([pa.array(out, pa.int64()), batch.column(2)], names=["n", "value"])

    return pieces.mapInArrow(number, "n bigint, value string")


def ordered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines with numbers that ascend in the input's order, with gaps where executors open the files themselves."""
    return ranges.placed(ranges.ranges(spark, path, "lines"), "n") if ranges.openable(path) else numbered(spark, path)
