"""FASTQ and FASTA as tables of reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.pairing import READ
from readloom.sources import ranges, text


def sniff(spark: SparkSession, path: str) -> str:
    """"fastq" or "fasta", by the first character that is no white space; anything else is an error."""
    start = text.lines(spark, path).where((F.col("split") == 0) & (F.trim("value") != "")).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    kind = {"@": "fastq", ">": "fasta"}.get(start["c"] if start else "")
    if kind is None:
        raise ValueError(f"{path}: neither FASTQ nor FASTA" if start else f"{path}: no records")
    return kind


def scan_fastq(spark: SparkSession, path: str, src: int = 1, dense: bool = True) -> DataFrame:
    """Reads of a four-line FASTQ file. A bad record fails the job with its number.

    Where executors can open the file (see ranges.openable), each reads a range of it that begins and ends at records;
    files are counted first only if ``dense`` asks for numbers without gaps, as pairing by position does. Files in other
    stores come through Spark's reader: records are put together where they are read, and those that straddle two
    splits are brought together.
    """
    if ranges.openable(path):
        found = ranges.ranges(spark, path, "fastq")
        return (ranges.counted(found) if dense else ranges.placed(found)).select(F.lit(src).alias("src"), "ord", "header", "sequence", "quality")
    return scan_fastq_lines(spark, path, src)


def scan_fastq_lines(spark: SparkSession, path: str, src: int = 1) -> DataFrame:
    """Reads of a FASTQ file in any store that Spark reads, from its numbered lines."""
    numbered = text.numbered(spark, path)
    first = text.lines(spark, path).where("split = 0").first()
    if first is not None and not first["value"].strip():  # the file begins with blank lines
        lead = numbered.where("trim(value) <> ''").agg(F.min("n")).first()[0] or 0
        numbered = numbered.where(F.col("n") >= lead).withColumn("n", F.col("n") - lead)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        for batch in batches:
            whole, parts = [], []
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = value.rstrip("\r")
                if held and held[-1][0] + 1 != n:
                    parts += held
                    held = []
                if n % 4 == 0 or held:
                    held.append((n, value))
                else:
                    parts.append((n, value))
                if len(held) == 4:
                    whole.append((held[0][0] // 4, *(v for _, v in held)))
                    held = []
            yield rows(whole, parts)
        yield rows([], held)

    def rows(whole: list, parts: list) -> pa.RecordBatch:
        blank = (None,) * 4
        every = [*whole, *((n // 4, *blank[: n % 4], v, *blank[n % 4 + 1 :]) for n, v in parts)]
        kinds = (pa.int64(), *(pa.string(),) * 4)
        return pa.record_batch([pa.array([r[i] for r in every], k) for i, k in enumerate(kinds)], names=["ord", "a", "b", "c", "d"])

    found = numbered.mapInArrow(records, "ord bigint, a string, b string, c string, d string")
    complete = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull()
    joined = found.where(~complete).groupBy("ord").agg(*(F.max(x).alias(x) for x in "abcd"))
    every = found.where(complete).unionByName(joined).where(F.concat_ws("", "a", "b", "c", "d") != "")  # blank lines may end the file
    good = complete & F.startswith("a", F.lit("@")) & F.startswith("c", F.lit("+")) & (F.length("b") == F.length("d"))
    bad = F.raise_error(F.concat(F.lit(f"{path}: bad FASTQ record "), F.col("ord").cast("string"))).cast("boolean")
    every = every.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(bad))
    return every.select(F.lit(src).alias("src"), "ord", F.substring(F.col("a"), 2, 1 << 30).alias("header"), F.col("b").alias("sequence"), F.col("d").alias("quality"))


def scan_fasta(spark: SparkSession, path: str, src: int = 1) -> DataFrame:
    """Records of a FASTA file, their sequence lines joined; the quality is null."""
    pieces = text.numbered(spark, path, "\n>", blank=False)
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", "")
    if sniff(spark, path) != "fasta":
        raise ValueError(f"{path}: no FASTA file")
    header = F.substring_index(body, "\n", 1)
    sequence = F.regexp_replace(F.substring(body, F.length(header) + 1, F.length(body)), r"\s", "")
    return pieces.select(F.lit(src).alias("src"), F.col("n").alias("ord"), header.alias("header"), sequence.alias("sequence"), F.lit(None).cast("string").alias("quality"))


def scan(spark: SparkSession, path: str, src: int = 1, dense: bool = True) -> DataFrame:
    """Reads of either format, told by the first character; numbers ascend, without gaps if ``dense``."""
    return scan_fastq(spark, path, src, dense) if sniff(spark, path) == "fastq" else scan_fasta(spark, path, src)


def scan_paired(spark: SparkSession, first: str, second: str | None = None, dense: bool = True) -> list[DataFrame]:
    """One or two inputs; two of different formats are an error. Reads that are paired by position need ``dense`` numbers."""
    kinds = [sniff(spark, p) for p in (first, second) if p]
    if len(set(kinds)) > 1:
        raise ValueError("one input is FASTQ and the other FASTA")
    return [scan(spark, p, i + 1, dense) for i, p in enumerate(p for p in (first, second) if p)]


def references(reads: DataFrame) -> DataFrame:
    """(ref_ord, name, ref) of records; none at all is an error."""
    if reads.isEmpty():
        raise ValueError("no reference sequences")
    return reads.select(F.col("ord").alias("ref_ord"), F.col("header").alias("name"), F.col("sequence").alias("ref"))


def first_reference(reads: DataFrame) -> tuple[str, str]:
    """(name up to its first white space, sequence) of the first record; an empty name is an error."""
    row = reads.orderBy("ord").limit(1).first()
    if row is None or not row["header"].split():
        raise ValueError("no named reference sequence")
    return row["header"].split()[0], row["sequence"]


def rendered(reads: DataFrame) -> DataFrame:
    """(ord, text): records as they stand in a file, without their last line end."""
    fastq = F.concat(F.lit("@"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")
    return reads.select("ord", F.coalesce(fastq, F.concat(F.lit(">"), "header", F.lit("\n"), "sequence")).alias("text"))


__all__ = ["READ", "first_reference", "references", "rendered", "scan", "scan_fasta", "scan_fastq", "scan_fastq_lines", "scan_paired", "sniff"]
