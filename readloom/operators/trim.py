"""Trimming and masking of reads as layers of columns over (sequence, lo, hi).

A read stays one buffer with a window [lo, hi). Clipping shrinks the window; masking writes N into the buffer, and
shrinks the window too for poly-G, barcodes and hard ends, but not for adapters and primers. Each layer is a select,
so the optimizer keeps the whole chain in one generated stage after the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import bases

LONGEST_KMER = 21
STEPS = ("poly_g", "adapter", "barcode", "primer", "hard")
ENDS = {"l": "l", "r": "r", "b": "b"}


@dataclass(frozen=True)
class Clipping:
    """Resolved options. None skips a side, or for barcodes searches it all; a barcode window of 0 finds nothing."""

    preserve_bases: bool = False
    polyg_left: int | None = None
    polyg_right: int | None = None
    adapter: str | None = None
    adapter_fuzzy: bool = False
    barcode: str | None = None
    barcode_distance: int = 0
    barcode_left: int | None = None
    barcode_right: int | None = None
    kmers: frozenset[str] = field(default_factory=frozenset)
    kmer_length: int = 0
    primer_left: int | None = None
    primer_right: int | None = None
    hard_left: int = 0
    hard_right: int = 0


def literal(value: str | None, preserve: bool) -> str | None:
    if value is None:
        return None
    if not value.strip():
        raise ValueError("an adapter or barcode can't be empty")
    if set(value.upper()) - set("ACGTN"):
        raise ValueError("an adapter or barcode consists of ACGTN only")
    return value if preserve else value.upper()


def clipping(
    preserve_bases: bool = False,
    polyg_trim: int | None = None, polyg_end: str = "b", polyg_left: int | None = None, polyg_right: int | None = None,
    adapter_trim: str | None = None, a_fuzzy: bool = False,
    barcode_trim: str | None = None, b_end: str = "b", b_restrict: int | None = None, b_restrict_left: int | None = None, b_restrict_right: int | None = None, b_hdist: int = 0,
    primer_trim: Iterable[str] | None = None, p_fuzzy: bool = False, p_kmer_length: int | None = None, p_end: str = "b", p_restrict: int = 30, p_restrict_left: int | None = None, p_restrict_right: int | None = None,
    hard_trim: int = 0, h_left: int | None = None, h_right: int | None = None,
) -> Clipping:
    """Options as users give them, checked and resolved by side; ``primer_trim`` are the primers' sequences."""
    if adapter_trim is not None and barcode_trim is not None:
        raise ValueError("adapters and barcodes exclude each other")
    for end in (polyg_end, b_end, p_end):
        if end.lower() not in ENDS:
            raise ValueError(f"an end is l, r or b, not {end}")
    if b_hdist not in range(4):
        raise ValueError(f"b_hdist is 0 to 3, not {b_hdist}")
    either = lambda own, common: common if own is None else own
    one = lambda end, side, own, common, other: either(own, common) if end.lower() in (side, "b") else other
    kmers, length = frozenset(), 0
    if primer_trim is not None:
        if p_kmer_length is None or p_kmer_length not in range(2, LONGEST_KMER + 1):
            raise ValueError(f"a k-mer length of 2 to {LONGEST_KMER} goes with primers")
        kmers, length = primer_kmers(primer_trim, p_kmer_length, p_fuzzy), p_kmer_length
    return Clipping(
        preserve_bases,
        one(polyg_end, "l", polyg_left, polyg_trim, None), one(polyg_end, "r", polyg_right, polyg_trim, None),
        literal(adapter_trim, preserve_bases), a_fuzzy,
        literal(barcode_trim, preserve_bases), b_hdist, one(b_end, "l", b_restrict_left, b_restrict, 0), one(b_end, "r", b_restrict_right, b_restrict, 0),
        kmers, length,
        one(p_end, "l", p_restrict_left, p_restrict, None) if kmers else None, one(p_end, "r", p_restrict_right, p_restrict, None) if kmers else None,
        either(h_left, hard_trim), either(h_right, hard_trim),
    )


def primer_kmers(primers: Iterable[str], k: int, fuzzy: bool) -> frozenset[str]:
    """All k-mers of the primers and their reverse complements; ``fuzzy`` adds those one base away, N included."""
    found = set()
    for primer in primers:
        for s in (primer.upper(), bases.complemented(primer.upper())):
            found |= {s[i : i + k] for i in range(len(s) - k + 1)}
    if fuzzy:
        found |= {m[:i] + c + m[i + 1 :] for m in found for i in range(k) for c in "ACGTN"}
    return frozenset(found)


def S() -> Column:  # noqa: N802
    return F.col("_s")


def LO() -> Column:  # noqa: N802
    return F.col("_lo")


def HI() -> Column:  # noqa: N802
    return F.col("_hi")


def view() -> Column:
    return bases.part(S(), LO(), HI() - LO())


def opened(reads: DataFrame, preserve_bases: bool) -> DataFrame:
    s = F.col("sequence") if preserve_bases else bases.canonical(F.col("sequence"))
    return reads.withColumn("_s", s).withColumns({"_lo": F.lit(0), "_hi": F.length("_s"), "_full": F.length("_s")})


def shrunk(df: DataFrame, lo: Column, hi: Column, mask: bool) -> DataFrame:
    """The window becomes [lo, hi); under ``mask`` what it loses is N."""
    df = df.withColumns({"_l": lo, "_h": hi})
    if mask:
        df = df.withColumn("_s", bases.masked(bases.masked(S(), LO(), F.col("_l") - LO()), F.col("_h"), HI() - F.col("_h")))
    return df.withColumns({"_lo": F.col("_l"), "_hi": F.col("_h")}).drop("_l", "_h")


def polyg(df: DataFrame, left: int | None, right: int | None, mask: bool) -> DataFrame:
    """Runs of G at the ends, if they are at least so long, are taken off whole; left before right."""
    if left is not None:
        df = df.withColumn("_n", bases.left_run(view()))
        df = shrunk(df, F.when(F.col("_n") >= left, LO() + F.col("_n")).otherwise(LO()), HI(), mask)
    if right is not None:
        df = df.withColumn("_n", bases.right_run(view()))
        df = shrunk(df, LO(), F.when(F.col("_n") >= right, HI() - F.col("_n")).otherwise(HI()), mask)
    return df.drop("_n")


def adapter(df: DataFrame, forward: str, fuzzy: bool, mask: bool) -> DataFrame:
    """One side at most: the reverse complement is cut with all after it, else the adapter with all before it; exact hits first."""
    n, back = len(forward), bases.complemented(forward)
    tries = [(True, back, 0), (False, forward, 0)] + ([(True, back, 1), (False, forward, 1)] if fuzzy else [])
    df = df.withColumn("_v", view())
    at = None
    for is_back, pattern, d in tries:
        df = df.withColumn("_p", bases.find(F.col("_v"), pattern, d) if at is None else F.when(F.col("_at") == 0, bases.find(F.col("_v"), pattern, d)).otherwise(0))
        if at is None:
            df = df.withColumns({"_at": F.col("_p"), "_back": F.lit(is_back)})
            at = True
        else:
            df = df.withColumns({"_back": F.when(F.col("_p") > 0, F.lit(is_back)).otherwise(F.col("_back")), "_at": F.col("_at") + F.col("_p")})
    hit = F.col("_at") > 0
    if mask:
        df = df.withColumn("_s", F.when(hit, bases.masked(S(), LO() + F.col("_at") - 1, F.lit(n))).otherwise(S()))
    else:
        lo = F.when(hit & ~F.col("_back"), LO() + F.col("_at") - 1 + n).otherwise(LO())
        hi = F.when(hit & F.col("_back"), LO() + F.col("_at") - 1).otherwise(HI())
        df = shrunk(df, lo, hi, False)
    return df.drop("_v", "_p", "_at", "_back")


def barcode(df: DataFrame, code: str, distance: int, left: int | None, right: int | None, mask: bool) -> DataFrame:
    """Left: the first hit in the first ``left`` bases goes with all before it. Right: the first hit of the reverse
    complement in the last ``right`` bases of what remains goes with all after it."""
    n = len(code)
    if left != 0:
        v = view() if left is None else bases.part(S(), LO(), F.least(HI() - LO(), F.lit(left)))
        df = df.withColumn("_p", bases.find(v, code, distance))
        df = shrunk(df, F.when(F.col("_p") > 0, LO() + F.col("_p") - 1 + n).otherwise(LO()), HI(), mask)
    if right != 0:
        start = LO() if right is None else F.greatest(LO(), HI() - right)
        df = df.withColumn("_b", start).withColumn("_p", bases.find(bases.part(S(), F.col("_b"), HI() - F.col("_b")), bases.complemented(code), distance))
        df = shrunk(df, LO(), F.when(F.col("_p") > 0, F.col("_b") + F.col("_p") - 1).otherwise(HI()), mask)
    return df.drop("_p", "_b")


def primer_hits(s: Column, kmers: frozenset[str], k: int) -> Column:
    """0-based starts of the windows of ``s`` that are in ``kmers`` (a set bounded by the primers, compiled into the plan)."""
    known = sorted(kmers)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(s) - k))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(s, i + 1, F.lit(k)).isin(known))


def masked_spans(s: Column, hits: Column, k: int) -> Column:
    """``s`` with N over ``k`` characters from each of the 0-based ``hits`` on."""
    return F.aggregate(hits, s, lambda done, i: bases.masked(done, i, F.lit(k)))


def primer(df: DataFrame, side: str, window: int, kmers: frozenset[str], k: int, mask: bool) -> DataFrame:
    """Left: through the right-most hit in the first ``window`` bases. Right: from the left-most hit in the last ones.
    Masking covers every hit and leaves the window as it is."""
    size = F.least(HI() - LO(), F.lit(window))
    start = LO() if side == "left" else HI() - size
    df = df.withColumn("_b", start).withColumn("_hits", primer_hits(bases.part(S(), F.col("_b"), size), kmers, k))
    hit = F.size("_hits") > 0
    if mask:
        df = df.withColumn("_s", masked_spans(S(), F.transform("_hits", lambda i: i + F.col("_b")), k))
    elif side == "left":
        df = shrunk(df, F.when(hit, F.col("_b") + F.array_max("_hits") + k).otherwise(LO()), HI(), False)
    else:
        df = shrunk(df, LO(), F.when(hit, F.col("_b") + F.array_min("_hits")).otherwise(HI()), False)
    return df.drop("_b", "_hits")


def hard(df: DataFrame, left: int, right: int, mask: bool) -> DataFrame:
    """So many bases off either end; all of a read that has no more than both together."""
    whole = HI() - LO() <= left + right
    if mask:
        df = df.withColumn("_s", F.when(whole, bases.masked(S(), LO(), HI() - LO())).otherwise(bases.masked(bases.masked(S(), LO(), F.lit(left)), HI() - right, F.lit(right))))
    return shrunk(df, F.when(whole, LO()).otherwise(LO() + left), F.when(whole, LO()).otherwise(HI() - right), False)


def trim(reads: DataFrame, options: Clipping, mask: bool = False, counts: bool = False) -> DataFrame:
    """``reads`` with header, sequence and quality trimmed (or the sequence masked).

    ``counts`` adds a boolean column per step (trimmed_<step>, trimmed_any): whether the step shortened the window,
    which under ``mask`` adapters and primers never do. Other columns stay.
    """
    df = opened(reads, options.preserve_bases)
    flags = {step: F.lit(False) for step in STEPS}

    def step(df: DataFrame, name: str, layer) -> DataFrame:
        if not counts:
            return layer(df)
        df = layer(df.withColumn("_was", HI() - LO())).withColumn(f"trimmed_{name}", HI() - LO() < F.col("_was")).drop("_was")
        flags.pop(name)
        return df

    if options.polyg_left is not None or options.polyg_right is not None:
        df = step(df, "poly_g", lambda d: polyg(d, options.polyg_left, options.polyg_right, mask))
    if options.adapter:
        df = step(df, "adapter", lambda d: adapter(d, options.adapter, options.adapter_fuzzy, mask))
    elif options.barcode:
        df = step(df, "barcode", lambda d: barcode(d, options.barcode, options.barcode_distance, options.barcode_left, options.barcode_right, mask))
    if options.kmers:

        def both(d: DataFrame) -> DataFrame:
            if options.primer_left is not None:
                d = primer(d, "left", options.primer_left, options.kmers, options.kmer_length, mask)
            if options.primer_right is not None:
                d = primer(d, "right", options.primer_right, options.kmers, options.kmer_length, mask)
            return d

        df = step(df, "primer", both)
    if options.hard_left or options.hard_right:
        df = step(df, "hard", lambda d: hard(d, options.hard_left, options.hard_right, mask))
    if counts:
        df = df.withColumns({f"trimmed_{name}": value for name, value in flags.items()} | {"trimmed_any": HI() - LO() < F.col("_full")})
    if mask:
        df = df.withColumn("sequence", S())
    else:
        df = df.withColumns({"sequence": view(), "quality": bases.part(F.col("quality"), LO(), HI() - LO())})
    return settled(df.drop("_s", "_lo", "_hi", "_full"), ["sequence", "quality", *(c for c in df.columns if c.startswith("trimmed_"))])


def settled(df: DataFrame, computed: list[str]) -> DataFrame:
    """``df`` with the ``computed`` columns as they are, out of a later filter's reach.

    A filter above would be pushed down through every layer, and as each layer names the one before several times, the
    pushed condition would double with each. It does not pass a generator; this one makes one row of one row.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in computed]
    return df.select(*rest, F.inline(F.array(F.struct(*computed)))).select(*(F.col(f"`{c}`") for c in df.columns))
