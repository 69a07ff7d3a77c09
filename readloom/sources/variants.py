"""Variant tables and square matrices of distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import sinks, text

TAG = "^([0-9]+)([A-Za-z])$"


def scan_variants(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(header line, rows): rows have ord, row (0, 1, ... without blank lines), line, position, allele."""
    lines = text.numbered(spark, path)
    head = lines.where("trim(value) <> ''").orderBy("n").limit(1).first()
    names = head["value"].split("\t") if head else []
    if len(names) < 5 or names[1] != "Position" or names[4] != "Minority_Allele":
        raise ValueError(f"{path}: the second column is Position and the fifth Minority_Allele")
    if "Phase" in names:
        raise ValueError(f"{path}: it has a Phase already")
    f = F.split("value", "\t")
    good = (F.size(f) >= 5) & F.get(f, F.lit(1)).rlike("^[0-9]+$") & F.get(f, F.lit(4)).rlike("^[A-Za-z]$")
    bad = F.raise_error(F.concat(F.lit(f"{path}: bad variant line "), F.col("n").cast("string"))).cast("boolean")
    rows = lines.where((F.trim("value") != "") & (F.col("n") > head["n"])).where(F.when(good, F.lit(True)).otherwise(bad))
    return head["value"], rows.select(F.col("n").alias("ord"), F.col("value").alias("line"), F.get(f, F.lit(1)).cast("long").alias("position"), F.get(f, F.lit(4)).alias("allele"))


def scan_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tags, edges): tags have row, position, allele; edges row, col, dist of the upper triangle.

    Rows with a wrong tag, a repeated tag, or another number of values than there are rows are errors.
    """
    lines = text.numbered(spark, path, blank=False).select("n", F.split("value", "\t").alias("f"))
    size = lines.count()
    tag = F.get("f", F.lit(0))
    bad = lines.where((F.size("f") != size + 1) | ~tag.rlike(TAG)).limit(1).collect()
    if bad or lines.select(tag).distinct().count() != size:
        raise ValueError(f"{path}: no square matrix of distinct tags" + (f", line {bad[0]['n']}" if bad else ""))
    rows = lines.withColumn("row", F.col("n").cast("int"))
    tags = rows.select("row", F.regexp_extract(tag, TAG, 1).cast("long").alias("position"), F.regexp_extract(tag, TAG, 2).alias("allele"))
    above = F.slice("f", F.col("row") + 3, F.greatest(F.lit(0), F.lit(size) - F.col("row") - 1))
    edges = rows.select("row", F.posexplode(above).alias("at", "value")).select("row", (F.col("row") + F.col("at") + 1).alias("col"), F.col("value").cast("double").alias("dist"))
    return tags, edges


def rewrite_phases(rows: DataFrame, header: str, path: str) -> None:
    """The table with a Phase column in the place of the file it was read from.

    The new table is written aside and whole before it is renamed over the old one, so a failing row or a lost driver
    leaves the file as it was.
    """
    sinks.write_file(phase_lines(rows, header), path)


def write_phases(rows: DataFrame, header: str, path: str) -> None:
    """The table with a Phase column as its last, to another folder than it was read from."""
    phase_lines(rows, header).orderBy("ord").select("text").write.text(path)


def phase_lines(rows: DataFrame, header: str) -> DataFrame:
    lines = rows.select("ord", F.concat("line", F.lit("\t"), F.col("phase").cast("string")).alias("text"))
    top = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit(f"{header}\tPhase").alias("text"))
    return top.unionByName(lines)
