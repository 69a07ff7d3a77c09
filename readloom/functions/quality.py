"""Columns over Phred+33 quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scores(q: Column) -> Column:
    letters = F.filter(F.split(q, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c) - 33)


def mean(q: Column) -> Column:
    """Arithmetic mean of the scores (the geometric mean of the error rates), in single precision; null if empty."""
    total = F.aggregate(scores(q), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(q) > 0, (total / F.length(q)).cast("float"))


def median(q: Column) -> Column:
    """Middle score, or the mean of the two middle ones; null if empty."""
    ranked = F.array_sort(scores(q))
    n = F.length(q)
    middle = F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (middle / 2).cast("float"))


def center(q: Column, use_median: bool) -> Column:
    return median(q) if use_median else mean(q)
