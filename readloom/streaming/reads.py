"""Read-by-read operators over a stream: no state, so they run as they are; output follows each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.trim import Clipping, trim


def trim_stream(reads: DataFrame, options: Clipping, mask: bool = False, min_length: int = 1) -> DataFrame:
    """``reads`` (a streaming table with the columns of a read) trimmed and filtered by length."""
    return trim(reads, options, mask).where(F.length("sequence") >= min_length)


def write_stream(reads: DataFrame, path: str, checkpoint: str):
    """A started query that appends to Parquet files, each read once even if the query is restarted."""
    return reads.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
