"""Phases of variants: components of the graph of near variants, ranked, and looked up for every variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import runtime
from readloom.operators.graph import components

HEIGHT = 0.78


def phases(tags: DataFrame, edges: DataFrame, height: float = HEIGHT) -> DataFrame:
    """(row, position, allele, phase): ``tags`` (row, position, allele) joined by ``edges`` (row, col, dist) of at most ``height``.

    Phases count from 1: larger components first, then by smallest position, smallest allele, and smallest row.
    Fewer than two tags are phase 1, whatever the edges.
    """
    if not 0 <= height <= 1:
        raise ValueError(f"a height is 0 to 1, not {height}")
    if tags.limit(2).count() < 2:
        return tags.select("row", "position", "allele", F.lit(1).cast("long").alias("phase"))
    near = edges.where(F.col("dist") <= height)
    label = components(near, "row", "col")
    placed = tags.join(label.hint("merge"), tags.row == label.node, "left").select("row", "position", "allele", F.coalesce("label", "row").alias("root"))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("position").alias("first"), F.min("allele").alias("least"))
    order = runtime.ranked(sizes, F.col("size").desc(), F.col("first"), F.col("least"), F.col("root")).select("root", (F.col("rank") + 1).alias("phase"))
    return placed.join(order.hint("merge"), "root").select("row", "position", "allele", "phase")


def with_phase(variants: DataFrame, found: DataFrame) -> DataFrame:
    """``variants`` (ord, line, position, allele) with their phase; a variant without one fails the job before anything is written."""
    names = found.select(F.col("position").alias("_p"), F.col("allele").alias("_a"), "phase")
    joined = variants.join(names, (variants.position == F.col("_p")) & (variants.allele == F.col("_a")), "left").drop("_p", "_a")
    missing = F.raise_error(F.concat(F.lit("no phase for "), F.col("position").cast("string"), F.col("allele"))).cast("boolean")
    return joined.where(F.when(F.col("phase").isNotNull(), F.lit(True)).otherwise(missing))
