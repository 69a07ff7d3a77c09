"""Cluster tables: one line per cluster with its members' headers and qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.dedup import cluster_number
from readloom.sources import text


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """(cluster_id, members) of lines; blank lines are passed over, and a last header without a quality."""
    f = F.split(value, "\t")
    pairs = F.floor((F.size("f") - 1) / 2).cast("int")
    numbers = F.when(pairs > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), pairs - 1))).otherwise(F.array().cast("array<int>"))
    members = F.transform(numbers, lambda i: F.struct(F.get("f", 1 + 2 * i).alias("header"), F.get("f", 2 + 2 * i).alias("quality")))
    return lines.where(F.trim(value) != "").select(f.alias("f")).select(cluster_number(F.get("f", F.lit(0))).alias("cluster_id"), members.alias("members"))


def scan_xfl(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def scan_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, sequence) of the clusters' FASTA file."""
    from readloom.sources.fastx import scan_fasta

    return scan_fasta(spark, path).select("ord", F.col("header").alias("name"), "sequence")


def cluster_name():
    return F.concat(F.lit("C"), F.col("cluster_id").cast("string"), F.lit("%"), F.col("size").cast("string"))


def rendered(clusters: DataFrame) -> DataFrame:
    """(cluster_id, text): the table's lines."""
    each = F.flatten(F.transform("members", lambda m: F.array(m["header"], m["quality"])))
    return clusters.select("cluster_id", F.array_join(F.concat(F.array(cluster_name()), each), "\t").alias("text"))


def rendered_sequences(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.concat(F.lit(">"), cluster_name(), F.lit("\n"), "sequence").alias("text"))
