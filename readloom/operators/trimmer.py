"""The trimmer: eight ways from one or two inputs to one or two outputs, with length and widow filters and counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from readloom.operators import pairing
from readloom.operators.trim import STEPS, Clipping, trim

FLAGS = (*(f"trimmed_{s}" for s in STEPS), "trimmed_any")


@dataclass
class Trimmed:
    """``outputs``: one or two tables of reads; ``counts``: one row of tallies over all input reads."""

    outputs: list[DataFrame]
    counts: DataFrame
    #: One for each output, where reads stay in their order: the tallies of what it was written from (``told`` adds them up).
    observed: list[Observation] = field(default_factory=list)

    def told(self) -> dict[str, int]:
        """The tallies, once all outputs have been written; without another pass where they were observed."""
        if not self.observed:
            return self.counts.first().asDict()
        found = [o.get for o in self.observed]
        return {name: sum(f[name] for f in found) for name in found[0]}


def judged(reads: DataFrame, options: Clipping, mask: bool, min_length: int) -> DataFrame:
    """Trimmed reads with ``kept``: long enough after clipping (masking leaves the length as it was)."""
    return trim(reads, options, mask, counts=True).withColumn("kept", F.length("sequence") >= min_length)


def sums(extra_widows: bool = False) -> list[Column]:
    """Counts over judged reads; ``seen`` is whether a read was trimmed at all, ``widow`` whether its mate fell."""
    total = lambda c: F.sum(c.cast("long"))
    seen = F.col("seen") if extra_widows else F.lit(True)
    widow = F.col("widow") if extra_widows else F.lit(False)
    found = {"total_processed": F.count(F.lit(1))} | {c.removeprefix("trimmed_"): total(F.col(c) & seen) for c in FLAGS}
    found |= {"length_filtered": total(~F.col("kept") & seen), "widow_filtered": total(widow)}
    return [F.coalesce(v, F.lit(0)).alias({"any": "total_trimmed"}.get(k, k)) for k, v in found.items()]


def tally(judgements: DataFrame, extra_widows: bool = False) -> DataFrame:
    return judgements.agg(*sums(extra_widows))


def trimmer(inputs: list[DataFrame], options: Clipping, outputs: int = 1, filter_widows: bool = False, mask: bool = False, min_length: int = 1) -> Trimmed:
    """Reads of one or two inputs, trimmed and filtered, as one (interleaved) or two tables.

    One input and one output without the widow filter is a stream of single reads; otherwise reads are pairs. With
    ``filter_widows`` both mates stay or none (a second mate is not trimmed once the first fell); without, mates are
    filtered one by one. Two inputs without the widow filter aren't checked to pair, and reads past the shorter one
    stay, after all pairs; everything else fails on unequal inputs or headers of two molecules.
    """
    if len(inputs) not in (1, 2) or outputs not in (1, 2):
        raise ValueError("one or two inputs, one or two outputs")
    if min_length < 1:
        raise ValueError("the minimum length is 1 or more")
    if len(inputs) == 1 and outputs == 1 and not filter_widows:
        done, seen = judged(inputs[0], options, mask, min_length), Observation()
        return Trimmed([done.observe(seen, *sums()).where("kept").select(*pairing.READ)], tally(done), [seen])
    if len(inputs) == 2 and not filter_widows:
        sides = [judged(x.withColumn("src", F.lit(i + 1)), options, mask, min_length) for i, x in enumerate(inputs)]
        both = sides[0].unionByName(sides[1])
        if outputs == 2:
            seen = [Observation(), Observation()]
            return Trimmed([s.observe(o, *sums()).where("kept").select(*pairing.READ) for s, o in zip(sides, seen)], tally(both), seen)
        kept = [s.where("kept").select(*pairing.READ) for s in sides]
        placed = [k.withColumn("ord", F.col("ord") * 2 + i) for i, k in enumerate(kept)]
        return Trimmed([placed[0].unionByName(placed[1])], tally(both))
    pairs = pairing.deinterleave(inputs[0]) if len(inputs) == 1 else pairing.zip_pairs(*inputs)
    single = pairing.interleave(pairs)  # trimmed as single reads, of which mates stay next to each other
    done = judged(single, options, mask, min_length)
    if not filter_widows:
        kept = done.where("kept")
        sides = [kept.where(F.col("src") == i).select(*pairing.READ).withColumn("ord", F.floor(F.col("ord") / 2)) for i in (1, 2)]
        return Trimmed(sides, tally(done))
    rows = pairing.adjacent(done.select("kept", *FLAGS, *pairing.READ)).withColumnsRenamed({"r1": "a", "r2": "b"}).withColumns({"a_in": F.col("a.kept"), "b_in": F.col("a.kept") & F.col("b.kept")})
    flags = lambda s: [F.col(f"{s}.{c}") for c in ("kept", *FLAGS)]
    # the first mate is always seen and is a widow if it stands but the second fell; the second is seen only if the first stands, and else is the widow
    first = rows.select(*flags("a"), F.lit(True).alias("seen"), (F.col("a.kept") & ~F.col("b.kept")).alias("widow"))
    second = rows.select(*flags("b"), F.col("a.kept").alias("seen"), (~F.col("a.kept")).alias("widow"))
    counts = tally(first.unionByName(second), extra_widows=True)
    whole = rows.where("b_in").select("pair_idx", *(F.struct(*(F.col(f"{s}.{c}") for c in pairing.READ)).alias(n) for s, n in (("a", "r1"), ("b", "r2"))))
    return Trimmed([pairing.interleave(whole)] if outputs == 1 else [pairing.mates(whole, 1), pairing.mates(whole, 2)], counts)


def report(counts: DataFrame | dict[str, int], options: Clipping, source: str, mask: bool = False, min_length: int = 1, widows: bool = False, primers: str | None = None) -> str:
    """The counts as aligned lines with percentages (0.00 of no reads)."""
    row = counts if isinstance(counts, dict) else counts.first().asDict()
    total, verb = row["total_processed"], "masked" if mask else "trimmed"

    def line(label: str, n: int, tail: str = "") -> str:
        return f"{label:<20} {n:>10} reads ({100 * n / total if total else 0:.2f}%)" + (f" {tail}" if tail else "")

    def sides(left: int, right: int, same: str, differ: str) -> str:
        return same.format(left) if left == right else differ.format(left, right)

    out = [f"Processed reads from {source}", f"{'Input:':<20} {total:>10} reads"]
    if options.polyg_left is not None or options.polyg_right is not None:
        out.append(line(f"PolyG {verb}:", row["poly_g"], sides(options.polyg_left or 0, options.polyg_right or 0, "with a PolyG threshold of {} bases", "with a left PolyG threshold of {} bases and a right PolyG threshold of {} bases")))
    if options.barcode:
        out.append(line(f"Barcode {verb}:", row["barcode"], f"with an allowable hamming distance of {options.barcode_distance}"))
    if options.adapter:
        out.append(line(f"Adapter {verb}:", row["adapter"], f"with {'fuzzy' if options.adapter_fuzzy else 'exact'} matching"))
    if options.kmers:
        out.append(line(f"Primer {verb}:", row["primer"], f"using primer set {primers}" if primers else ""))
    if options.hard_left or options.hard_right:
        out.append(line(f"Hard {verb}:", row["hard"], sides(options.hard_left, options.hard_right, "with an amount of {} bases", "with an amount of {} bases on the left and {} bases on the right")))
    out.append(line(f"Total {verb}:", row["total_trimmed"]))
    out.append(line("Length filtered:", row["length_filtered"], f"for being shorter than the minimum post-trimming length of {min_length}"))
    if widows:
        out.append(line("Widow filtered:", row["widow_filtered"], f"for their paired read being shorter than the minimum post-trimming length of {min_length}"))
    return "\n".join(out)
