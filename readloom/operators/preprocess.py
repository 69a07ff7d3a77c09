"""Preparation of reads for assembly: clip, gate by length and quality, repair headers, deflate, and log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import headers, quality
from readloom.operators import dedup, pairing
from readloom.operators.trim import Clipping, trim


def judged(reads: DataFrame, options: Clipping, min_length: int, min_quality: int, use_median: bool = False, enforce_clipped: bool = False) -> DataFrame:
    """Clipped reads with raw_length, long_raw, long_clipped, q and passed, side by side with what each gate said."""
    raw = reads.withColumn("raw_length", F.length("sequence")).withColumn("long_raw", F.col("raw_length") >= min_length)
    cut = trim(raw, options).withColumn("q", quality.center(F.col("quality"), use_median))
    long_clipped = (F.length("sequence") > 0) & ((F.length("sequence") >= min_length) if enforce_clipped else F.lit(True))
    cut = cut.withColumn("long_clipped", F.col("long_raw") & long_clipped)
    return cut.withColumn("passed", F.col("long_clipped") & (F.col("q") >= F.lit(min_quality).cast("float")))


def with_widow_rule(rows: DataFrame) -> DataFrame:
    """Of each pair (pair_idx, src 1 and 2): the second mate is looked at only if the first passed, and both are stored or none."""
    one = F.struct(*rows.columns)
    pairs = rows.groupBy("pair_idx").agg(F.max(F.when(F.col("src") == 1, one)).alias("a"), F.max(F.when(F.col("src") == 2, one)).alias("b"))
    both = F.array(
        F.struct(*(F.col(f"a.{c}") for c in rows.columns), F.lit(True).alias("seen"), (F.col("a.passed") & F.col("b.passed")).alias("stored")),
        F.struct(*(F.col(f"b.{c}") for c in rows.columns), F.col("a.passed").alias("seen"), (F.col("a.passed") & F.col("b.passed")).alias("stored")),
    )
    return pairs.select(F.inline(both))


def preprocess(inputs: list[DataFrame], options: Clipping, min_length: int, min_quality: int, use_median: bool = False, enforce_clipped: bool = False, filter_widows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stored reads, one row of figures). Reads of two inputs are sides 1 and 2.

    With ``filter_widows`` reads pair by position up to the first pair that is not one; from there on, as past the end
    of the shorter input, they count singly.
    """
    if len(inputs) not in (1, 2):
        raise ValueError("one or two inputs")
    reads = inputs[0].withColumn("src", F.lit(1 if len(inputs) == 2 else 0))
    if len(inputs) == 2:
        reads = reads.unionByName(inputs[1].withColumn("src", F.lit(2)))
    rows = judged(reads, options, min_length, min_quality, use_median, enforce_clipped)
    if filter_widows and len(inputs) == 2:
        bad = pairing.zip_pairs(*inputs, check=False).where(pairing.fault().isNotNull()).agg(F.min("pair_idx")).first()[0]
        rows = rows.withColumn("pair_idx", F.col("ord"))
        paired = rows if bad is None else rows.where(F.col("ord") < bad)
        done = with_widow_rule(paired)
        if bad is not None:
            done = done.unionByName(rows.where(F.col("ord") >= bad).withColumns({"seen": F.lit(True), "stored": F.col("passed")}))
        rows = done.drop("pair_idx")
    else:
        rows = rows.withColumns({"seen": F.lit(True), "stored": F.col("passed")})
    count = lambda c: F.coalesce(F.sum((c & F.col("seen")).cast("long")), F.lit(0))
    most = lambda c, when: F.coalesce(F.max(F.when(when & F.col("seen"), c)), F.lit(0))
    figures = rows.agg(
        count(F.col("src") < 2).alias("raw_1"), count(F.col("src") == 2).alias("raw_2"),
        most(F.col("raw_length"), F.lit(True)).alias("max_len"), most(F.length("sequence"), F.col("long_raw")).alias("max_clipped_len"),
        F.max(F.when(F.col("long_clipped") & F.col("seen"), F.col("q"))).alias("q_max"),
        count(F.col("long_clipped")).alias("passed_len"), count(F.col("passed")).alias("passed_qc"),
    )
    side = F.when(F.col("src") > 0, F.col("src"))
    stored = rows.where("stored").select("src", "ord", headers.repaired(F.col("header"), side).alias("header"), "sequence", "quality")
    return stored, figures


def log(stored: DataFrame, figures: DataFrame, files: int, min_length: int, min_quality: int, use_median: bool = False) -> DataFrame:
    """The twelve key and value rows of the quality-control log, in order."""
    patterns = dedup.cluster_sizes(stored).agg(F.count(F.lit(1)).alias("patterns"))
    one = figures.crossJoin(patterns)  # two tables of one row
    values = [
        ("NUMBER_INPUT_FILES", F.lit(files)), ("OBSERVED_RAW_READS_OR_R1", F.col("raw_1")), ("OBSERVED_R2_READS", F.col("raw_2")),
        ("OBSERVED_MAX_READ_LEN", F.col("max_len")), ("OBSERVED_MAX_CLIPPED_READ_LENGTH", F.col("max_clipped_len")),
        ("OBSERVED_MAX_QUALITY", F.coalesce(F.regexp_replace(F.col("q_max").cast("string"), r"\.0$", ""), F.lit("NONE"))),
        ("READ_COUNT_PASSING_ONLY_LENGTH_FILTER", F.col("passed_len")), ("READ_COUNT_PASSING_ALL_QUALITY_CONTROL_FILTERS", F.col("passed_qc")),
        ("READ_PATTERN_COUNT_PASSING", F.col("patterns")), ("MIN_PHRED_QUALITY_THRESHOLD", F.lit(min_quality)), ("MIN_READ_LENGTH_THRESHOLD", F.lit(min_length)),
        ("QUALITY_MEASURE", F.lit("median" if use_median else "average")),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("row"), F.lit(k).alias("key"), v.cast("string").alias("value")) for i, (k, v) in enumerate(values)))
    return one.select(F.inline(rows))


def diagnosis(figures: DataFrame, files: int, min_length: int, min_quality: int) -> list[str]:
    """Why no read passed, as warnings."""
    row = figures.first()
    if files == 1 and not row["raw_1"]:
        return ["No reads were found in the input file."]
    if files == 2 and not (row["raw_1"] and row["raw_2"]):
        return ["No reads were found in " + ("either input file." if not (row["raw_1"] or row["raw_2"]) else f"the {'second' if row['raw_1'] else 'first'} input file.")]
    out = []
    if row["q_max"] is not None and row["q_max"] < min_quality:
        out.append(f"The observed max phred quality score ({row['q_max']:g}) is below the threshold ({min_quality}).")
    if row["max_len"] < min_length:
        out.append(f"The observed max read length ({row['max_len']}) is below the threshold ({min_length}).")
    return out
