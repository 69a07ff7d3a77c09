"""Merging of aligned read pairs along their reference, with agreement statistics; one row in, one row out, no explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import headers
from readloom.operators.pair_kernel import OUT, STATS, merge_batches

FIELDS = ("ord", "qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")
LABELS = ("obs", "tmv", "fmv", "dmv", "insObs", "insErr")


def pair_up(sam: DataFrame, rname: str) -> DataFrame:
    """(mol, r1, r2, dropped): rows on ``rname`` by molecule; either mate may be null, later ones of a slot are dropped.

    A header that says side 1 or 2 takes that slot; other rows take slot 1 if the molecule is new, else 2. The first
    to come takes a slot. All steps share one shuffle by molecule and one sort.
    """
    once = F.get(F.transform(F.array("qname"), headers.molecule), F.lit(0))  # generated code of all dialects is too long to be compiled
    rows = sam.where(F.col("rname") == rname).withColumn("m", once)
    rows = rows.select(*FIELDS, F.coalesce("m.id", "qname").alias("mol"), F.col("m.side").alias("side"))
    arrival = F.row_number().over(Window.partitionBy("mol").orderBy("ord"))
    slot = F.when(F.col("side").isin("1", "2"), F.col("side").cast("int")).when(arrival == 1, F.lit(1)).otherwise(F.lit(2))
    one = F.struct(*FIELDS)  # the first by ord is the least
    take = lambda n: F.min(F.when(F.col("slot") == n, one)).alias(f"r{n}")
    taken = F.count_if(F.col("slot") == 1), F.count_if(F.col("slot") == 2)
    dropped = sum((F.greatest(n - 1, F.lit(0)) for n in taken[1:]), F.greatest(taken[0] - 1, F.lit(0))).alias("dropped")
    return rows.withColumn("slot", slot).groupBy("mol").agg(take(1), take(2), dropped)


def merged(pairs: DataFrame, reference: str, bowtie: bool = False) -> DataFrame:
    """``pairs`` with both mates and qualities as merged rows: mol, the SAM fields, and the six counters.

    ``reference`` is one sequence and goes to every task. One unmapped mate leaves the other as it is but for the name; two
    leave an unmapped row; neither counts. Batches of pairs are merged in arrays (pair_kernel).
    """
    return merged_or_not(pairs.withColumn("whole", F.lit(True)), reference, bowtie)


def merged_or_not(pairs: DataFrame, reference: str, bowtie: bool) -> DataFrame:
    """``merged`` of the ``whole`` pairs, and the rows of the others as they are, that count nothing: both from one reading."""
    name = F.col("r1.qname") if bowtie else F.get(F.transform(F.array("r1.qname"), headers.merged_name), F.lit(0))
    own = [F.col(f"r{n}.{c}").alias(f"{c}{n}") for n in (1, 2) for c in FIELDS if c != "qname"]
    apart = [F.when(~F.col("whole"), F.col(f"r{n}.qname")).alias(f"qname{n}") for n in (1, 2)]
    there = [F.col(f"r{n}").isNotNull().alias(f"there{n}") for n in (1, 2)]
    flat = pairs.select("mol", "whole", F.when(F.col("whole"), name).alias("name"), *own, *apart, *there)
    letters = reference.encode("latin-1")
    return flat.mapInArrow(lambda batches: merge_batches(batches, letters), OUT)


def mergeable() -> Column:
    """Both mates are there, with qualities."""
    found = F.col("r1").isNotNull() & F.col("r2").isNotNull() & ~F.col("r1.qual").isin("", "*") & ~F.col("r2.qual").isin("", "*")
    return F.coalesce(found, F.lit(False))


def merge_sam(sam: DataFrame, rname: str, reference: str, bowtie: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): merged pairs, and as they are the single reads and the pairs without qualities; one row of counters.

    Rows on other references, and third and later records of a molecule, are left out (``pair_up`` counts those).
    """
    done = merged_or_not(pair_up(sam, rname).withColumn("whole", mergeable()), reference, bowtie)
    stats = done.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS))
    return done.select(*FIELDS), stats


def stats_rows(stats: DataFrame, rname: str) -> DataFrame:
    """(row, name, metric, value): the counters as the six lines of the statistics file."""
    rows = F.array(*(F.struct(F.lit(i).alias("row"), F.lit(rname).alias("name"), F.lit(label).alias("metric"), F.col(s).alias("value")) for i, (s, label) in enumerate(zip(STATS, LABELS))))
    return stats.select(F.inline(rows))
