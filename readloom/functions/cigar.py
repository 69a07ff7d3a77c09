"""Columns over CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"(\d+)([MIDNSHP=X])"


def runs(cigar: Column) -> Column:
    """array<struct<n, op>> in order; characters that are no run are passed over."""
    counts, ops = F.regexp_extract_all(cigar, F.lit(RUN), F.lit(1)), F.regexp_extract_all(cigar, F.lit(RUN), F.lit(2))
    return F.zip_with(counts, ops, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def expanded(cigar: Column) -> Column:
    """One character per base: 2M1D is MMD."""
    return F.array_join(F.transform(runs(cigar), lambda r: F.repeat(r["op"], r["n"])), "")


def condensed(ops: Column) -> Column:
    """The run-length form of an expanded string; characters that are no operation are left out."""
    clean = F.regexp_replace(ops, "[^MIDNSHP=X]", "")
    return F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(r"((.)\2*)"), F.lit(1)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
