"""Pairs of reads: by position in two inputs, by neighbours in one, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import headers
from readloom.operators.trim import settled

READ = ("src", "ord", "header", "sequence", "quality")


class PairingError(ValueError):
    """Told by ``check_pairs`` before anything is written."""


def read_struct(df: DataFrame, name: str, *more: str) -> Column:
    return F.struct(*(df[c] for c in READ + more)).alias(name)


def zip_pairs(first: DataFrame, second: DataFrame, check: bool = True) -> DataFrame:
    """(pair_idx, r1, r2): the i-th read of either input. With ``check`` an unmatched read or two molecules fail the job;
    without, the other side of an unmatched read is null."""
    a = first.select(F.col("ord").alias("pair_idx"), read_struct(first, "r1"))
    b = second.select(F.col("ord").alias("pair_idx"), read_struct(second, "r2"))
    pairs = a.join(b, "pair_idx", "full_outer")
    return checked(pairs) if check else pairs


def deinterleave(reads: DataFrame, check: bool = True) -> DataFrame:
    """(pair_idx, r1, r2): reads 0 and 1, 2 and 3, ... of one input; an odd read out fails the job.

    Mates are neighbours, so most are paired by the task that reads both. Only reads whose mate is not next to them,
    at the ends of partitions, are shuffled; for them the input is read a second time. Input in any other order is right too.
    """
    own = reads.select(*READ)
    one = "struct<" + ",".join(f"{c}:{t}" for c, t in own.dtypes) + ">"
    pairs = f"pair_idx bigint, r1 {one}, r2 {one}"
    whole = own.mapInArrow(lambda batches: neighbours(batches, alone=False), pairs)
    ends = own.mapInArrow(lambda batches: neighbours(batches, alone=True), pairs)
    return checked(whole.unionByName(ends.groupBy("pair_idx").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))), check)


def adjacent(reads: DataFrame) -> DataFrame:
    """(pair_idx, r1, r2) of reads of which each has its mate next to it, as interleave gives them; without a shuffle."""
    one = "struct<" + ",".join(f"{c}:{t}" for c, t in reads.dtypes) + ">"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, given = 0, 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read
            for batch in batches:
                read += batch.num_rows
                yield batch

        for out in neighbours(counted(), alone=False):
            given += out.num_rows
            yield out
        if read != 2 * given:
            raise ValueError("mates are not next to each other")

    return reads.mapInArrow(pairs, f"pair_idx bigint, r1 {one}, r2 {one}")


def neighbours(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
    """(pair_idx, r1, r2) of rows with ``ord``: those whose mate is the next row, or only the others, if ``alone``."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        ords = rows["ord"].to_numpy()
        first = np.flatnonzero((ords[:-1] % 2 == 0) & (ords[1:] == ords[:-1] + 1))
        open_end = len(ords) > 0 and ords[-1] % 2 == 0  # its mate may begin the next batch
        held = rows.slice(len(ords) - 1) if open_end else None
        if alone:
            left = np.ones(len(ords), bool)
            left[first] = left[first + 1] = False
            left[len(ords) - 1 :] &= not open_end
            yield from halves(rows.take(pa.array(np.flatnonzero(left))))
        elif len(first):
            yield paired(ords[first] // 2, as_struct(rows.take(pa.array(first))), as_struct(rows.take(pa.array(first + 1))))
    if alone and held is not None:
        yield from halves(held)


def as_struct(rows: pa.Table) -> pa.Array:
    return rows.combine_chunks().to_struct_array().combine_chunks() if rows.num_rows else pa.array([], pa.struct(list(rows.schema)))


def paired(places: np.ndarray, first: pa.Array, second: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(places, pa.int64()), first, second], names=["pair_idx", "r1", "r2"])


def halves(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if rows.num_rows:
        ords, own = rows["ord"].to_numpy(), as_struct(rows)
        sides = [pc.if_else(pa.array(ords % 2 == n), own, pa.scalar(None, own.type)) for n in (0, 1)]
        yield paired(ords // 2, *sides)


def checked(pairs: DataFrame, ids: bool = True) -> DataFrame:
    """``pairs`` through a filter that raises on the first bad pair it meets; no later projection can drop it."""
    told = settled(pairs.withColumn("_fault", fault(ids)), ["_fault"])
    return told.where(F.when(F.col("_fault").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_fault")).cast("boolean"))).drop("_fault")


def fault(ids: bool = True) -> Column:
    """What is wrong with a pair, or null."""
    out = F.when(F.col("r1").isNull(), F.concat(F.lit("extra second read: "), F.col("r2.header"))).when(F.col("r2").isNull(), F.concat(F.lit("extra first read: "), F.col("r1.header")))
    if ids:
        out = out.when(~headers.same_molecule(F.col("r1.header"), F.col("r2.header")), F.concat(F.lit("unpaired headers: "), F.col("r1.header"), F.lit(" and "), F.col("r2.header")))
    return out


def check_pairs(pairs: DataFrame, ids: bool = True) -> None:
    """Raises PairingError for the first bad pair, by position."""
    bad = pairs.select("pair_idx", fault(ids).alias("fault")).where("fault is not null").orderBy("pair_idx").limit(1).collect()
    if bad:
        raise PairingError(f"pair {bad[0]['pair_idx']}: {bad[0]['fault']}")


def interleave(pairs: DataFrame) -> DataFrame:
    """Reads in the order r1, r2, r1, r2, ...; a missing mate leaves a gap in the numbers."""
    side = lambda n: F.struct((F.col("pair_idx") * 2 + n).alias("ord"), F.lit(n + 1).alias("src"), *(F.col(f"r{n + 1}.{c}") for c in READ[2:]))
    both = F.array(F.when(F.col("r1").isNotNull(), side(0)), F.when(F.col("r2").isNotNull(), side(1)))
    return pairs.select(F.inline(F.filter(both, lambda x: x.isNotNull()))).select(*READ)


def mates(pairs: DataFrame, side: int) -> DataFrame:
    """The reads of one side, numbered by their pair."""
    own = pairs.where(F.col(f"r{side}").isNotNull())
    return own.select(F.lit(side).alias("src"), F.col("pair_idx").alias("ord"), *(F.col(f"r{side}.{c}") for c in READ[2:]))
