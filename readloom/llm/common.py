"""Helpers shared by the text operators: table access, batch bounds, fresh names; durable cuts and components come from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.graph import components
from readloom.runtime import durable, shared_folder, spread

__all__ = ["bounded_batches", "components", "durable", "fresh", "shared_folder", "table", "text_of"]

#: Arrow batches handed to Python hold at most so many rows and bytes (a single longer text still fits alone).
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that long texts don't add up in a Python worker.

    Spark plans batches by the session's settings when a result is asked for, so they can't be set for one operator; a
    session that has smaller bounds keeps them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended until they clash with no column of ``df`` (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
