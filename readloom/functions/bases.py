"""Columns over nucleotide strings."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, in both cases.
CODES = "ACGTUNRYSWKMBVDHacgtunryswkmbvdh"
COMPLEMENTS = "TGCAANYRSWMKVBHDtgcaanyrswmkvbhd"
#: Mismatch patterns up to this many become one regular expression; more are compared position by position.
PATTERNS = 300


def canonical(s: Column) -> Column:
    """Upper-case ACGTN; every other character is N (each character once, so the length stays)."""
    return F.upper(F.regexp_replace(s, "[^ACGTNacgtn]", "N"))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, CODES, COMPLEMENTS))


def complemented(s: str) -> str:
    return s.translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def part(s: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the 0-based ``start`` on."""
    return F.substring(s, start + 1, length)


def left_run(s: Column, base: str = "G") -> Column:
    return F.length(F.regexp_extract(s, f"^{base}*", 0))


def right_run(s: Column, base: str = "G") -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, f"{base}+$", ""))


def within(pattern: str, mismatches: int) -> str:
    """A regular expression of strings as long as ``pattern`` that differ from it in at most ``mismatches`` places."""
    return "|".join("".join("." if i in free else c for i, c in enumerate(pattern)) for free in combinations(range(len(pattern)), min(mismatches, len(pattern))))


def find(s: Column, pattern: str, mismatches: int = 0) -> Column:
    """1-based place of the left-most window of ``s`` within ``mismatches`` of ``pattern``; 0 if there is none."""
    n = len(pattern)
    if mismatches == 0:
        return F.instr(s, pattern)
    if comb(n, min(mismatches, n)) <= PATTERNS:
        return F.regexp_instr(s, F.lit(within(pattern, mismatches)))
    letters = F.array(*(F.lit(c) for c in pattern))
    differ = lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda seen, j: seen + (F.substring(s, i + j, F.lit(1)) != F.get(letters, j)).cast("int")
    )
    places = F.when(F.length(s) >= n, F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - (n - 1))), lambda i: differ(i) <= mismatches))
    return F.coalesce(F.get(places, F.lit(0)), F.lit(0))


def windows(s: Column, k: int) -> Column:
    """The k-mers of ``s`` in order; none if it is shorter."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def masked(s: Column, start: Column, length: Column) -> Column:
    """``s`` with N over ``length`` characters from the 0-based ``start`` on."""
    return F.concat(F.substring(s, F.lit(1), start), F.repeat(F.lit("N"), length), F.substring(s, start + length + 1, F.length(s)))
