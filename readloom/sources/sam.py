"""SAM files: header lines and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import text


def scan_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header lines with ord, rows with ord and the eleven fields' used ones and tags). A short row fails the job."""
    lines = text.ordered(spark, path).where("trim(value) <> ''")
    head = lines.where("value like '@%'").select(F.col("n").alias("ord"), F.col("value").alias("line"))
    f = F.split("value", "\t")
    rows = lines.where("value not like '@%'").withColumn("f", F.when(F.size(f) >= 11, f).otherwise(F.raise_error(F.concat(F.lit(f"{path}: short SAM row "), F.col("n").cast("string"))).cast("array<string>")))
    at = lambda i, kind="string": F.get("f", F.lit(i)).cast(kind)
    named = [("qname", 0, "string"), ("flag", 1, "int"), ("rname", 2, "string"), ("pos", 3, "int"), ("mapq", 4, "int"), ("cigar", 5, "string"), ("seq", 9, "string"), ("qual", 10, "string")]
    return head, rows.select(F.col("n").alias("ord"), *(at(i, k).alias(n) for n, i, k in named), F.slice("f", F.lit(12), F.size("f")).alias("tags"))


def rendered(rows: DataFrame) -> DataFrame:
    """(ord, text): rows as SAM lines; mates are not told."""
    return rows.select("ord", F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual").alias("text"))
