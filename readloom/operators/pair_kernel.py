"""The merge of aligned mates over whole Arrow batches: all pairs of a batch side by side in arrays of reference positions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = re.compile(r"(\d+)([MIDNSHP=X])")
FRONT, BACK = re.compile(r"^(?:\d+[HS])*"), re.compile(r"[MIDNP=X]((?:\d+[HS])*)$")
GAP, SKIP, WORST = ord("-"), ord("N"), ord("!")
STATS = ("observations", "true_variations", "variant_errors", "deletion_errors", "insert_obs", "insert_errors")
OUT = "mol string, ord bigint, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, " + ", ".join(f"{s} bigint" for s in STATS)


class Layout(NamedTuple):
    """What a CIGAR string says of any read: per reference position the read's base (-1 deleted, -2 skipped), insertions
    (after which position, first base, bases), clipped bases at both ends, and all bases of the read."""

    bases: np.ndarray
    inserts: list[tuple[int, int, int]]
    front: int
    back: int
    length: int


@lru_cache(1 << 16)
def layout(cigar: str) -> Layout:
    parts, inserts, q, r = [], [], 0, 0
    for n, op in RUN.findall(cigar):
        n = int(n)
        if op == "P":
            raise ValueError("padding in a CIGAR string is not supported")
        if op in "M=X":
            parts.append(np.arange(q, q + n))
        elif op in "DN":
            parts.append(np.full(n, -1 if op == "D" else -2))
        elif op == "I":
            inserts.append((r - 1, q, n))
        q += n if op in "M=XIS" else 0
        r += n if op in "M=XDN" else 0
    back = BACK.search(cigar)
    clip = lambda text: sum(int(n) for n, _ in RUN.findall(text))
    return Layout(np.concatenate(parts) if parts else np.empty(0, "i8"), inserts, clip(FRONT.match(cigar)[0]), clip(back[1]) if back else 0, q)


class Mates:
    """One side of all pairs: letters of all reads in a row, and the layouts."""

    def __init__(self, pos: list[int], cigars: list[str], seqs: list[str], quals: list[str]) -> None:
        self.layouts = [layout(c) for c in cigars]
        self.seqs, self.quals = seqs, quals
        for s, q, x in zip(seqs, quals, self.layouts):
            if len(s) < x.length or len(q) < x.length:
                raise ValueError("a read is shorter than its CIGAR string")
        self.start = np.array(pos, "i8") - 1
        self.sizes = np.array([len(x.bases) for x in self.layouts], "i8")
        self.end = self.start + self.sizes

    def laid(self, texts: list[str], skipped: tuple[int, int]) -> np.ndarray:
        """The letters of all reads at their reference positions, one read after the other."""
        letters = np.frombuffer("".join(texts).encode("latin-1"), "u1")
        first = np.cumsum([0, *map(len, texts)])[:-1]
        at = np.concatenate([x.bases for x in self.layouts]) if len(self.layouts) else np.empty(0, "i8")
        out = np.where(at == -1, skipped[0], skipped[1]).astype("u1")
        own = at >= 0
        out[own] = letters[(at + np.repeat(first, self.sizes))[own]]
        return out


def merged_batch(pairs: dict[str, list], reference: bytes) -> dict[str, list]:
    """Merged rows of pairs that are both mapped: start, cigar, seq, qual and the counters, in order."""
    one, two = (Mates(*(pairs[f"{c}{n}"] for c in ("pos", "cigar", "seq", "qual"))) for n in (1, 2))
    start, end = np.minimum(one.start, two.start), np.maximum(one.end, two.end)
    widths = np.maximum(end - start, 0)
    if (end > len(reference)).any() or (start < 0).any():
        raise ValueError("an alignment goes past the end of the reference")
    first = np.concatenate([[0], np.cumsum(widths)])
    total, count = int(first[-1]), len(start)
    owner = np.repeat(np.arange(count), widths)
    ref = np.frombuffer(reference, "u1")[np.arange(total) - first[owner] + start[owner]] if total else np.empty(0, "u1")

    def spread(side: Mates, values: np.ndarray) -> np.ndarray:
        out = np.zeros(total, "u1")
        at = np.arange(len(values)) + np.repeat(first[:-1] + side.start - start - np.concatenate([[0], np.cumsum(side.sizes)])[:-1], side.sizes)
        out[at] = values
        return out

    x, qx = spread(one, one.laid(one.seqs, (GAP, SKIP))), spread(one, one.laid(one.quals, (WORST, WORST)))
    y, qy = spread(two, two.laid(two.seqs, (GAP, SKIP))), spread(two, two.laid(two.quals, (WORST, WORST)))
    has_x, has_y = x > 0, y > 0
    both, differ = has_x & has_y, has_x & has_y & (x != y)
    plain = np.zeros(256, bool)
    plain[list(b"ACGT")] = True
    wide_x, wide_y = qx.astype("i2"), qy.astype("i2")
    rules = [x == ref, y == ref, y == GAP, x == GAP, plain[x] & ~plain[y], plain[y] & ~plain[x], wide_x > wide_y + 4, wide_y > wide_x + 4]
    side = np.select(rules, [1, 2, 1, 2, 1, 2, 1, 2], 0)
    base = np.where(differ, np.select([side == 1, side == 2], [x, y], SKIP), np.where(has_x, x, y))
    qual = np.where(differ, np.select([side == 1, side == 2], [qx, qy], ((wide_x + wide_y) // 2).astype("u1")), np.maximum(qx, qy))
    op = np.select([differ, ~has_x & ~has_y, base == GAP], [ord("M"), ord("N"), ord("D")], ord("M")).astype("u1")
    keep = (has_x | has_y) & (base != GAP)
    counts = {
        "observations": both, "true_variations": both & (x == y) & ((x == GAP) | (x != ref)), "variant_errors": differ,
        "deletion_errors": differ & ((x == GAP) | (y == GAP)),
    }
    sums = {name: np.bincount(owner[flags], minlength=count) for name, flags in counts.items()}
    sums |= {name: np.zeros(count, "i8") for name in STATS[4:]}

    places, letters, marks = [], [], []
    for pair, place, s, q, seen, wrong in insertions(one, two, start, end):
        sums["insert_obs"][pair] += seen
        sums["insert_errors"][pair] += wrong
        if s:
            places.append(first[pair] + place)
            letters.append(s.lower().encode("latin-1"))
            marks.append(q.encode("latin-1"))
    sizes = np.array([len(s) for s in letters], "i8")
    after = np.repeat(np.array(places, "i8"), sizes)
    kept = np.cumsum(keep)
    joined = lambda parts: np.frombuffer(b"".join(parts), "u1")
    at_kept = kept[after] if len(after) else after
    seq, quals = np.insert(base[keep], at_kept, joined(letters)), np.insert(qual[keep], at_kept, joined(marks))
    ops, op_owner = np.insert(op, after + 1, ord("I")), np.insert(owner, after + 1, owner[after] if len(after) else after)
    own_sizes = np.bincount(owner[keep], minlength=count) + np.bincount(owner[after] if len(after) else [], minlength=count).astype("i8")
    cuts = np.concatenate([[0], np.cumsum(own_sizes)])
    shown = lambda letters: [letters[a:b].tobytes().decode("latin-1") for a, b in zip(cuts, cuts[1:])]
    seqs, quals = shown(seq), shown(quals)
    ends = np.flatnonzero((ops[1:] != ops[:-1]) | (op_owner[1:] != op_owner[:-1])) + 1 if len(ops) else np.empty(0, "i8")
    bounds = np.concatenate([[0], ends, [len(ops)]]) if len(ops) else np.zeros(1, "i8")
    runs: list[list[str]] = [[] for _ in range(count)]
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        runs[op_owner[a]].append(f"{b - a}{chr(ops[a])}")
    cigars = []
    for i, own in enumerate(runs):
        front = max(0, *(s.layouts[i].front - int(s.start[i] - start[i]) for s in (one, two)))
        back = max(0, *(s.layouts[i].back - int(end[i] - s.end[i]) for s in (one, two)))
        cigars.append("".join([f"{front}H" if front else "", *own, f"{back}H" if back else ""]) if widths[i] else None)
    none = widths == 0
    return {"pos": (start + 1).tolist(), "cigar": cigars, "seq": [None if n else s for n, s in zip(none, seqs)], "qual": [None if n else s for n, s in zip(none, quals)], **{k: v.tolist() for k, v in sums.items()}}


def insertions(one: Mates, two: Mates, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, str, str, int, int]]:
    """(pair, place, letters, qualities, observed, wrong) of the insertions of either mate after one reference position.

    Both mates' insertions must agree, or the one that the other contains stays; a lone one stays only where the other
    mate doesn't cover both neighbours.
    """
    own = [(pair, side) for pair, (a, b) in enumerate(zip(one.layouts, two.layouts)) for side in (0, 1) if (a, b)[side].inserts]
    found: dict[tuple[int, int], list] = {}
    for pair, side in own:
        mates = (one, two)[side]
        for r, q, n in mates.layouts[pair].inserts:
            place = int(mates.start[pair] + r - start[pair])
            if 0 <= place < end[pair] - start[pair]:
                slot = found.setdefault((pair, place), [None, None])
                slot[side] = slot[side] or (mates.seqs[pair][q : q + n], mates.quals[pair][q : q + n])
    for (pair, place), (i, j) in found.items():
        if i and j:
            s, q = i if i[0] in j[0] else j if j[0] in i[0] else ("", "")
            if i[0] == j[0]:
                q = "".join(map(max, i[1], j[1]))
            yield pair, place, s, q, 1, int(i[0] != j[0])
        else:
            mate = two if i else one
            at = start[pair] + place
            if mate.start[pair] <= at and at + 1 < mate.end[pair]:
                yield pair, place, "", "", 1, 1
            else:
                yield pair, place, *(i or j), 0, 0


def merge_batches(batches: Iterator[pa.RecordBatch], reference: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of OUT for batches of (mol, whole, name, and of either mate ord, flag, rname, pos, mapq, cigar, seq, qual, qname, there with its number).

    Pairs that aren't whole give the rows of the mates that are there.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split(" ") for f in OUT.split(", ")]
    for every in batches:
        batch = every.filter(every.column("whole"))
        rest = every.filter(pc.invert(every.column("whole")))
        for n in (1, 2):
            own = rest.filter(rest.column(f"there{n}"))
            if own.num_rows:
                zeros = pa.array(np.zeros(own.num_rows, "i8"))
                columns = [own.column("mol") if c == "mol" else zeros if c in STATS else own.column(f"{c}{n}").cast(kinds[k]) for c, k in fields]
                yield pa.record_batch(columns, names=[c for c, _ in fields])
        if not batch.num_rows:
            continue
        rows = {name: column.to_pylist() for name, column in zip(batch.schema.names, batch.columns)}
        gone = [[bool(f & 4) or c in ("*", "") for f, c in zip(rows[f"flag{n}"], rows[f"cigar{n}"])] for n in (1, 2)]
        whole = [i for i, (a, b) in enumerate(zip(*gone)) if not (a or b)]
        out = {c: [None] * batch.num_rows for c in ("flag", "rname", "pos", "mapq", "cigar", "seq", "qual")} | {s: [0] * batch.num_rows for s in STATS}
        done = merged_batch({c: [rows[c][i] for i in whole] for c in rows if c[:-1] in ("pos", "cigar", "seq", "qual")}, reference)
        for c, values in done.items():
            for i, v in zip(whole, values):
                out[c][i] = v
        for i, (a, b) in enumerate(zip(*gone)):
            if a and b:
                values = (4, rows["rname1"][i], 0, 255, "*", "*", "*")
            elif a or b:
                values = tuple(rows[f"{c}{2 if a else 1}"][i] for c in ("flag", "rname", "pos", "mapq", "cigar", "seq", "qual"))
            else:
                values = (0, rows["rname1"][i], out["pos"][i], (rows["mapq1"][i] + rows["mapq2"][i]) // 2, out["cigar"][i], out["seq"][i], out["qual"][i])
            for c, v in zip(("flag", "rname", "pos", "mapq", "cigar", "seq", "qual"), values):
                out[c][i] = v
        own = {"mol": rows["mol"], "ord": rows["ord1"], "qname": rows["name"], **out}
        yield pa.record_batch([pa.array(own[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])
