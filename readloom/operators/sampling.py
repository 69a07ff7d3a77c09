"""Down-sampling of reads or pairs: by a chance per record, or exactly n of them."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from readloom.runtime import durable

BITS = 16


def sample_fraction(df: DataFrame, percent: int, *keys: str, seed: int = 0, lot: Column | None = None, bits: int = 64) -> DataFrame:
    """Each row with a chance of ``percent`` in 100, in one pass over an input of unknown size.

    With ``keys`` a row's lot decides, so that reruns and rows that share their keys agree; without, Spark's own sampler.
    ``lot`` is another lot of ``bits`` bits, at least 0; the default is signed.
    """
    check_percent(percent)
    if not keys and lot is None:
        return df.sample(False, percent / 100, seed)
    if percent == 100:
        return df
    below = (percent << bits) // 100
    return df.where(draw(*keys, seed=seed) < below - (1 << 63) if lot is None else lot < below)


def check_percent(percent: int) -> None:
    if not isinstance(percent, int) or not 0 <= percent <= 100:
        raise ValueError(f"a percentage is a whole number of 0 to 100, not {percent}")


def draw(*keys: str, seed: int = 0) -> Column:
    """A number of 64 bits that stands for the row's lot: the same for the same keys and seed, whatever the partitions."""
    return F.xxhash64(*keys, F.lit(seed))


def sample_exact(df: DataFrame, n: int, *keys: str, seed: int = 0, lot: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, with a warning, if there are fewer), those with the smallest lots.

    ``keys`` identify a row; rows that share them share their lot. A histogram of the lots' top bits tells which
    ranges are wholly in; only the range that holds the n-th lot is sorted, a 65,536th of the rows.
    """
    lots = df.withColumn("_lot", draw(*keys, seed=seed) if lot is None else lot)
    top = F.shiftright("_lot", 64 - BITS)
    sizes = sorted((r["top"], r["count"]) for r in lots.groupBy(top.alias("top")).count().collect())
    left, edge = n, None
    for value, count in sizes:
        if count > left:
            edge = value
            break
        left -= count
    if edge is None:
        if left > 0:
            warnings.warn(f"{n} of {n - left} rows were asked for; all are taken", stacklevel=2)
        return df
    inside = lots.where(top < edge)
    if left:
        inside = inside.unionByName(lots.where(top == edge).orderBy("_lot", *keys).limit(left))
    return inside.drop("_lot")


def sample_reservoir(df: DataFrame, n: int, *keys: str, seed: int = 0, lot: Column | None = None) -> tuple[DataFrame, int]:
    """(what sample_exact takes, the number of all rows), from one pass over an input of unknown size.

    Each partition keeps the rows of its ``n`` smallest lots; of n rows of each, the n smallest are those of all. They are
    written to the shared folder, and the choice among them is sample_exact's, so no task holds n rows of all partitions.
    """
    seen = Observation()
    lots = df.withColumn("_lot", draw(*keys, seed=seed) if lot is None else lot).observe(seen, F.count(F.lit(1)).alias("rows"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for batch in batches:
            if left > 0:
                yield batch.slice(0, left)
            left -= batch.num_rows  # the rest is read to its end, as it counts

    held = durable(lots.sortWithinPartitions("_lot", *keys).mapInArrow(smallest, lots.schema))
    return sample_exact(held.withColumnRenamed("_lot", "_own"), n, *keys, lot=F.col("_own")).drop("_own"), seen.get["rows"]


def sample(df: DataFrame, *keys: str, target: int | None = None, percent: int | None = None, seed: int = 0) -> DataFrame:
    """``target`` rows, or ``percent`` of 100 of the known number of rows, rounded down. One of the two is given."""
    if (target is None) == (percent is None):
        raise ValueError("either a target or a percentage")
    if percent is not None:
        check_percent(percent)
        target = df.count() * percent // 100
    return sample_exact(df, target, *keys, seed=seed)


def summary(before: int, after: int) -> str:
    return f"Downsampled {before} records to {after} ({100 * after / before if before else 0:.2f} %)."
