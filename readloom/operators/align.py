"""Local alignment of queries to references with affine gaps; best match, strands, and tallies."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from readloom.functions import bases, headers

DNA, PROTEIN = "ACGTN", "ACDEFGHIKLMNPQRSTVWY*BJZX"
PLACED = "struct<at:int,strand:string,score:bigint,ref_start:int,cigar:string>"
#: References up to this many letters in all are broadcast to the queries; more are joined by shuffled pairs.
BROADCAST_LETTERS = 8 << 20
#: Letters of queries in a block of the grid that larger references are aligned in, and pairs that a task aligns at a time.
LINE_LETTERS, CELL_PAIRS = 1 << 16, 1 << 14
#: Such blocks hold up to this many letters once there are four for each core.
LARGEST_LINE = 1 << 20
#: References that a row of queries and references stands for, where all pairs are asked for.
BLOCK = 16
FITTING = 254
#: Cells of one table that pairs are swept in together (a longer pair stands alone).
CELLS = 1 << 21
#: Bytes of one diagonal, and of one table that is kept, which queries of a shared reference are swept in together; queries
#: that make that worth it; references that go side by side.
ROW_BYTES, TABLE_BYTES, SHARED, SIDES = 1 << 18, 1 << 24, 8, 8
#: References from this many letters on are searched by seeds; queries with more hits than this are swept.
LONG, HITS = 1 << 14, 1 << 18
#: Scores past this are errors, as is usual; tables have 32-bit cells where no cell can come near it.
CAPACITY = (1 << 31) - 1
#: The way to an alignment: one sweep over whole tables; three sweeps of which only a band is kept; its score alone.
METHODS = ("1pass", "3pass", "scores")
#: A band begins so wide on either side of the straight way, and doubles until it holds a best alignment.
BAND = 16
Found = tuple[int, int, str]
UNMAPPED = (None, None, None)
#: Operations by way: from the diagonal, from a query letter against a gap, from a reference letter against one.
OPERATIONS = "MID"
#: What proteins are scored by where nothing is said.
DEFAULT_MATRIX = "blosum62"


@dataclass(frozen=True)
class Scoring:
    """Weights between letters of an alphabet; other letters count as its last. Gaps cost open + extend x (length - 1)."""

    alphabet: str
    weights: tuple[tuple[int, ...], ...]
    gap_open: int = 10
    gap_extend: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.gap_extend <= self.gap_open <= 127:
            raise ValueError("gap penalties are 0 to 127, opening at least extending")


def simple(match: int | None = None, mismatch: int | None = None, alphabet: str = "dna", ignore_n: bool = False, gap_open: int = 10, gap_extend: int = 1) -> Scoring:
    """One score for equal letters and one penalty for others; what is not given is 2 and 5."""
    if alphabet not in ("dna", "aa"):
        raise ValueError("the alphabet is dna or aa")
    if alphabet == "aa" and ignore_n:
        raise ValueError("ignore_n goes with the DNA alphabet only")
    if alphabet == "aa" and match is None and mismatch is None:
        raise ValueError("proteins need scores or a matrix (see named())")
    match, mismatch = 2 if match is None else match, 5 if mismatch is None else mismatch
    if not (0 <= match <= 127 and 0 <= mismatch <= 127):
        raise ValueError("scores are 0 to 127")
    letters = DNA if alphabet == "dna" else PROTEIN
    weigh = lambda a, b: 0 if ignore_n and "N" in (a, b) else match if a == b else -mismatch
    return Scoring(letters, tuple(tuple(weigh(a, b) for b in letters) for a in letters), gap_open, gap_extend)


def named(table: str | Mapping[tuple[str, str], int], gap_open: int = 10, gap_extend: int = 1) -> Scoring:
    """A protein substitution matrix: the text of a published matrix file (# comments, a line of letters, rows), or pairs."""
    if isinstance(table, str):
        lines = [line.split() for line in table.splitlines() if line.strip() and not line.startswith("#")]
        table = {(row[0], b): int(w) for row in lines[1:] for b, w in zip(lines[0], row[1:])}
    least = min(table.values())
    return Scoring(PROTEIN, tuple(tuple(table.get((a, b), table.get((b, a), least)) for b in PROTEIN) for a in PROTEIN), gap_open, gap_extend)


def matrix_text(name: str, folder: str | None = None) -> str:
    """The text of a matrix: of the file that ``name`` is the path of, or of the file of that name, in any case, in ``folder``.

    Published matrices are files of some 600 numbers and not part of the library.
    """
    if os.path.isfile(name):
        found = name
    else:
        files = {f.rsplit(".", 1)[0].lower(): f for f in sorted(os.listdir(folder))} if folder and os.path.isdir(folder) else {}
        if name.lower() not in files:
            raise ValueError(f"no matrix {name}: give the path of its file, or a folder with it as --matrix-folder or READLOOM_MATRICES")
        found = os.path.join(folder, files[name.lower()])
    with open(found, encoding="utf-8") as f:
        return f.read()


def encoded(s: str, alphabet: str) -> np.ndarray:
    return letter_numbers(alphabet)[np.frombuffer(s.encode("latin-1", "replace"), "u1")]


@lru_cache(8)
def letter_numbers(alphabet: str) -> np.ndarray:
    table = np.full(256, len(alphabet) - 1, "i4")
    for i, c in enumerate(alphabet):
        table[ord(c)] = table[ord(c.lower())] = i
    return table


def local_alignment(query: str, reference: str, scoring: Scoring, method: str = "1pass") -> Found | None:
    """(score, 0-based start on the reference, CIGAR with soft-clipped ends) of the best local alignment; none at score 0."""
    return local_alignments([query], [reference], scoring, method)[0]


def local_alignments(queries: list[str], references: list[str], scoring: Scoring, method: str = "1pass") -> list[Found | None]:
    """The best local alignment of each query with its reference, in order.

    Pairs are swept together, those of like sizes in one array, a query letter at a time over whole references: a gap
    along the reference is a running maximum, as opening costs at least extending. "1pass" keeps the tables of all
    letters; "3pass" keeps one row, first for the end, then backwards for the start, and then the tables of a band
    between them, so its memory grows with the lengths and not with their product. Both give the same score and end;
    of several best alignments they may show different ones.
    """
    out: list[Found | None] = [None] * len(queries)
    if method == "1pass":
        alike, rest = shared(queries, references)
        for reference, own in alike:
            for i, found in zip(own, traced_alike([queries[i] for i in own], reference, scoring)):
                out[i] = found
        for group in ([rest[i] for i in g] for g in grouped([queries[i] for i in rest], [references[i] for i in rest], lambda n, m: (n + 1) * (m + 1))):
            for i, found in zip(group, swept([queries[i] for i in group], [references[i] for i in group], scoring)):
                out[i] = found
        return out
    if method != "3pass":
        raise ValueError(f"no method {method}")
    ends = best_cells(queries, references, scoring)
    lossless = [score > 0 and bounds(encoded(queries[i][:n], scoring.alphabet), scoring).loss(score) == 0 for i, (score, n, m) in enumerate(ends)]
    far = [0 if score <= 0 or done else m - reach(queries[i][:n], score, m, scoring) for i, ((score, n, m), done) in enumerate(zip(ends, lossless))]
    back = [(queries[i][:n][::-1], references[i][far[i] : m][::-1]) if score > 0 and not lossless[i] else ("", "") for i, (score, n, m) in enumerate(ends)]
    starts = best_cells([q for q, _ in back], [r for _, r in back], scoring, anchored=True)
    for i, ((score, n, m), (again, left, up)) in enumerate(zip(ends, starts)):
        if score > 0:
            if lossless[i]:
                left = up = n
                core = f"{n}M"
            elif again != score:
                raise AssertionError("an alignment scores differently backwards")
            else:
                core = banded(queries[i][n - left : n], references[i][m - up : m], score, scoring)
            clips = (n - left, len(queries[i]) - n)
            out[i] = score, m - up, "".join([f"{clips[0]}S" if clips[0] else "", core, f"{clips[1]}S" if clips[1] else ""])
    return out


def local_scores(queries: list[str], references: list[str], scoring: Scoring) -> list[int]:
    """The best local score of each query with its reference, 0 if nothing matches."""
    out = [0] * len(queries)
    alike, rest = shared(queries, references)
    for reference, own in alike:
        for i, score in zip(own, score_table([queries[i] for i in own], [reference], scoring)[0].tolist()):
            out[i] = score
    for i, (score, _, _) in zip(rest, best_cells([queries[i] for i in rest], [references[i] for i in rest], scoring)):
        out[i] = score
    return out


def shared(queries: list[str], references: list[str]) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """Pairs with letters on both sides: those of each reference that at least SHARED queries meet, and the numbers of the others."""
    found: dict[str, list[int]] = {}
    for i, (q, r) in enumerate(zip(queries, references)):
        if q and r:
            found.setdefault(r, []).append(i)
    alike = [(r, own) for r, own in found.items() if len(own) >= SHARED and len(r) < LONG]
    taken = {r for r, _ in alike}
    return alike, [i for r, own in found.items() if r not in taken for i in own]


class Lot(NamedTuple):
    """Queries of like lengths side by side along the last axis: their numbers and lengths, what each of their letters weighs
    against each letter of the alphabet and one that matches nothing (a row for each of both), and the number that stands for score 0.

    Cells are as small as the largest score allows, mostly bytes; 0 stands so high that no sum falls below the type.
    """

    numbers: list[int]
    sizes: np.ndarray
    weighed: np.ndarray
    zero: int


def lots_of(queries: list[str], m: int, scoring: Scoring, count_of) -> Iterator[Lot]:
    """All queries with letters in lots, ``count_of(letters, bytes of a cell)`` of a length in one, for references of up to ``m`` letters."""
    order = sorted((i for i, q in enumerate(queries) if q), key=lambda i: len(queries[i]))
    weights = np.array(scoring.weights, "i8")
    size, zero = len(weights), max(scoring.gap_open + scoring.gap_extend, -int(weights.min()), 1)
    code, at = letter_numbers(scoring.alphabet).astype("u1").tobytes(), 0
    while at < len(order):
        count = max(1, count_of(len(queries[order[at]]), 1))
        n = len(queries[order[min(at + count, len(order)) - 1]])  # of the longest, which is the last
        kind = next(k for k in ("u1", "i2", "i4", "i8") if max(0, int(weights.max())) * min(n, m) + zero <= np.iinfo(k).max)
        count = min(count, max(1, count_of(n, np.dtype(kind).itemsize)))
        lot = order[at : at + count]
        at += len(lot)
        sizes = np.array([len(queries[i]) for i in lot])
        letters = np.full((len(lot), sizes.max()), size, "u1")  # ends in a letter that matches nothing
        letters[np.arange(sizes.max()) < sizes[:, None]] = np.frombuffer("".join([queries[i] for i in lot]).encode("latin-1", "replace").translate(code), "u1")
        letters = np.ascontiguousarray(letters.T)
        table = np.pad(weights, (0, 1), constant_values=-1).astype(kind)
        weighed = np.empty((letters.shape[0], size + 1, len(lot)), kind)
        for a in range(size + 1):
            if kind == "u1":
                weighed[:, a] = np.frombuffer(letters.tobytes().translate(table[:, a].tobytes() + bytes(255 - size)), "u1").reshape(letters.shape)
            else:
                weighed[:, a] = table[:, a][letters]
        yield Lot(lot, sizes, weighed.reshape(-1, len(lot)), zero)


def diagonals(lot: Lot, r: np.ndarray, scoring: Scoring, space: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best scores by query letter and pair of a lot with references (columns of letters), pairs of one reference side by side; where
    ``space`` gives three rows of bytes, the whole tables lie in them: best, ending in a query letter against a gap, and in a
    reference letter against one, by (query letter + reference letter, query letter, pair).

    Cells of a diagonal need those of the two before only, so a step is one over all of them, gaps of any length included.
    """
    size, (m, sides), zero, kind = len(scoring.alphabet) + 1, r.shape, lot.zero, lot.weighed.dtype
    n, count = len(lot.weighed) // size, lot.weighed.shape[1] * sides
    first, more, low = (np.array(x, kind) for x in (scoring.gap_open, scoring.gap_extend, zero - scoring.gap_open))
    lines = 3 if space is None else n + m + 1
    cells = lines * (n + 1) * count
    best, down, right = np.empty((3, lines, n + 1, count), kind) if space is None else (x[: cells * kind.itemsize].view(kind).reshape(lines, n + 1, count) for x in space)
    floor, spare = np.full((n + 1, count), zero, kind), np.empty((n + 1, count), kind)
    peaks, rows = floor.copy(), size * np.arange(n + 1)[:, None]
    for d in range(n + m + 1):
        now, one, two = (x % lines for x in (d, d - 1, d - 2))
        best[now, 0], down[now, 0], right[now, 0] = zero, low, low
        if d <= n:
            best[now, d], right[now, d] = zero, low
        a, b = max(1, d - m), min(n, d - 1) + 1  # query letters on this diagonal
        if d < 2 or a >= b:
            continue
        left, up, here = right[now, a:b], down[now, a:b], best[now, a:b]
        opened = np.subtract(best[one, a - 1 : b], first, out=spare[a - 1 : b])
        np.subtract(right[one, a:b], more, out=left)
        np.maximum(left, opened[1:], out=left)
        np.subtract(down[one, a - 1 : b - 1], more, out=up)
        np.maximum(up, opened[:-1], out=up)
        np.take(lot.weighed, rows[a - 1 : b - 1] + r[d - b : d - a][::-1], axis=0, out=here.reshape(b - a, sides, -1), mode="clip")
        np.add(here, best[two, a - 1 : b - 1], out=here)
        np.maximum(here, left, out=here)
        np.maximum(here, up, out=here)
        np.maximum(here, floor[a:b], out=here)
        np.maximum(peaks[a:b], here, out=peaks[a:b])
    return peaks, (best, down, right)


def score_table(queries: list[str], references: list[str], scoring: Scoring) -> np.ndarray:
    """The best local score of each query (columns) with each reference (rows), 0 if nothing matches."""
    out = np.zeros((len(references), len(queries)), "i8")
    short = sorted((k for k, r in enumerate(references) if r and len(r) < LONG and len(queries) >= SHARED), key=lambda k: len(references[k]))
    at = 0
    while at < len(short):  # those that are at most an eighth longer go side by side
        group = [k for k in short[at : at + SIDES] if 8 * len(references[k]) <= 9 * len(references[short[at]])]
        at += len(group)
        r = padded([references[k] for k in group], scoring.alphabet).T
        for lot in lots_of(queries, len(r), scoring, lambda n, size: ROW_BYTES // (n + 1) // size // len(group)):
            peaks = diagonals(lot, r, scoring)[0].max(axis=0).astype("i8") - lot.zero
            out[np.ix_(group, lot.numbers)] = peaks.reshape(len(group), -1)
    for k in set(range(len(references))) - set(short):
        out[k] = [score for score, _, _ in best_cells(queries, [references[k]] * len(queries), scoring)]
    capable(int(out.max(initial=0)))
    return out


def traced_alike(queries: list[str], reference: str, scoring: Scoring) -> list[Found | None]:
    """What ``traced`` finds for each query with one reference; all ways of a lot are walked side by side."""
    out: list[Found | None] = [None] * len(queries)
    r, first, more = encoded(reference, scoring.alphabet)[:, None], scoring.gap_open, scoring.gap_extend
    m = len(r)
    cells = lambda n: (n + m + 1) * (n + 1)
    large = [i for i, q in enumerate(queries) if 8 * cells(len(q)) > TABLE_BYTES]
    for group in ([large[i] for i in g] for g in grouped([queries[i] for i in large], [reference] * len(large), lambda n, m: (n + 1) * (m + 1))):
        for i, found in zip(group, swept([queries[i] for i in group], [reference] * len(group), scoring)):
            out[i] = found
    small = ["" if 8 * cells(len(q)) > TABLE_BYTES else q for q in queries] if large else queries
    space = np.empty((3, TABLE_BYTES), "u1")
    for lot in lots_of(small, m, scoring, lambda n, size: TABLE_BYTES // cells(n) // size):
        peaks, (best, down, right) = diagonals(lot, r, scoring, space)
        lines, count = len(peaks), len(lot.numbers)
        best, down, right, line = best.ravel(), down.ravel(), right.ravel(), lines * count
        score, i = peaks.max(axis=0), peaks.argmax(axis=0)
        k = np.flatnonzero(score > lot.zero)
        row = (i[k] * lines + i[k]) * count + k
        ends, last = np.zeros(count, "i8"), i.copy()
        ends[k] = row + line * (1 + (best[row + line * np.arange(1, m + 1)[:, None]] == score[k]).argmax(axis=0))
        back = np.array([2 * line + count, line + count, line])  # a cell's steps to those that it comes from, by way
        at, gap, here, steps = ends[k], np.zeros(len(k), "u1"), score[k], []
        while len(k):
            across, along = right[at], down[at]
            way = np.where(gap > 0, gap, np.where(here == across, 2, np.where(here == along, 1, 0))).astype("u1")
            ops = np.zeros(count, "u1")
            ops[k] = way + 1
            steps.append(ops)
            at = at - back[way]
            here, gap = best[at], np.zeros(len(k), "u1")
            ends[k] = at
            for kind, own, table in ((1, along, down), (2, across, right)):
                g = np.flatnonzero(way == kind)
                if len(g):  # (values of types without signs, none of which falls below 0)
                    gap[g] = np.where((own[g] == table[at[g]] - own.dtype.type(more)) & (own[g] != here[g] - own.dtype.type(first)), kind, 0)
            alive = (gap > 0) | (here > lot.zero)
            if not alive.all():
                k, at, gap, here = k[alive], at[alive], gap[alive], here[alive]
        if not steps:
            continue
        i = ends // count % lines
        tops = (score.astype("i8") - lot.zero).tolist()
        capable(max(tops))
        clip = ["", *(f"{x}S" for x in range(1, lines))]
        for number, top, start, head, tail, core in zip(lot.numbers, tops, (ends // line - i).tolist(), i.tolist(), (lot.sizes - last).tolist(), runs_of(np.stack(steps[::-1], axis=1))):
            if top:
                out[number] = top, start, clip[head] + core + clip[tail]
    return out


def runs_of(ways: np.ndarray) -> list[str]:
    """The CIGAR of each row of numbers into OPERATIONS from 1; a row may begin with zeros."""
    size = ways.shape[1]
    begins = ways > 0
    begins[:, 1:] &= ways[:, 1:] != ways[:, :-1]
    row, at = np.nonzero(begins)
    after = np.append(at[1:], size)
    after[np.append(row[1:] != row[:-1], True)] = size
    names = [f"{n}{op}" for op in OPERATIONS for n in range(size + 1)]
    runs = [names[x] for x in ((ways[row, at].astype("i8") - 1) * (size + 1) + after - at).tolist()]
    cuts = np.searchsorted(row, np.arange(len(ways) + 1)).tolist()
    return ["".join(runs[a:b]) for a, b in zip(cuts, cuts[1:])]


def grouped(queries: list[str], references: list[str], cells_of) -> list[list[int]]:
    """Numbers of the pairs with letters on both sides, in lots of like sizes whose tables stay within CELLS."""
    order = sorted((i for i in range(len(queries)) if queries[i] and references[i]), key=lambda i: (len(references[i]), len(queries[i])))
    lots, longest = [], 0
    for i in order:
        longest = max(longest, len(queries[i])) if lots else len(queries[i])
        if not lots or (len(lots[-1]) + 1) * cells_of(longest, len(references[i])) > CELLS:
            lots.append([])
            longest = len(queries[i])
        lots[-1].append(i)
    return lots


def cell_type(n: int, m: int, scoring: Scoring) -> tuple[str, int]:
    """The type of a table's cells, and a number below all sums in it."""
    most = max(scoring.gap_open, *(abs(w) for row in scoring.weights for w in row))
    return ("i4", -(1 << 29)) if (n + m + 2) * most < 1 << 29 else ("i8", -(1 << 60))


def capable(score: int) -> int:
    if score > CAPACITY:
        raise OverflowError("the score exceeds the capacity of a signed 32-bit number")
    return score


def weights_of(scoring: Scoring, kind: str, low: int) -> np.ndarray:
    """The weights with a last letter that pads texts and matches nothing."""
    size = len(scoring.alphabet)
    out = np.full((size + 1, size + 1), low, kind)
    out[:size, :size] = scoring.weights
    return out


def best_cells(queries: list[str], references: list[str], scoring: Scoring, anchored: bool = False) -> list[tuple[int, int, int]]:
    """(score, query letters, reference letters) up to the first best cell, of alignments from anywhere, or from both starts if ``anchored``."""
    out = [(0, 0, 0)] * len(queries)
    first, more = scoring.gap_open, scoring.gap_extend
    if not anchored:
        for i, (q, r) in enumerate(zip(queries, references)):
            if r and len(r) >= LONG and q and (found := seeded(q, r, scoring)):
                out[i] = found
        left_out = [i for i, found in enumerate(out) if not found[0]]
        if len(left_out) < len(out):
            for i, found in zip(left_out, best_cells([queries[i] for i in left_out], ["" if not references[i] else references[i] for i in left_out], scoring) if left_out else []):
                out[i] = found
            return out
    for group in grouped(queries, references, lambda n, m: m + 1):
        q, r = (padded([side[i] for i in group], scoring.alphabet) for side in (queries, references))
        count, n, m = len(q), q.shape[1], r.shape[1]
        kind, low = cell_type(n, m, scoring)
        weights, ramp = weights_of(scoring, kind, low), (more * np.arange(m + 1)).astype(kind)
        best, down, right = np.zeros((count, m + 1), kind), np.full((count, m + 1), low, kind), np.full((count, m + 1), low, kind)
        if anchored:
            best[:, 1:] = -first - ramp[:-1]
        score, left, up = np.zeros(count, kind), np.zeros(count, "i8"), np.zeros(count, "i8")
        for i in range(1, n + 1):
            down = np.maximum(best - first, down - more)
            row = down.copy() if anchored else np.maximum(down, 0)
            np.maximum(row[:, 1:], best[:, :-1] + weights[q[:, i - 1, None], r], out=row[:, 1:])
            right[:, 1:] = np.maximum.accumulate(row + ramp, axis=1)[:, :-1] - first - ramp[1:] + more
            best = np.maximum(row, right)
            peak = best.max(axis=1)
            for k in np.flatnonzero(peak > score):
                score[k], left[k], up[k] = peak[k], i, best[k].argmax()
        for k, i in enumerate(group):
            out[i] = capable(int(score[k])), int(left[k]), int(up[k])
    return out


class Bounds(NamedTuple):
    """What a query's letters can score at most, the least that a wrong letter costs it, and the least that a letter gives."""

    most: int
    wrong: int
    least: int
    sure: bool

    def loss(self, score: int) -> int:
        """What an alignment of this score is short of the most; -1 if equal letters aren't each letter's only best ones."""
        return self.most - score if self.sure else -1


def bounds(query: np.ndarray, scoring: Scoring) -> Bounds:
    weights = np.array(scoring.weights, "i8")
    own = weights.diagonal()
    others = np.where(np.eye(len(weights), dtype=bool), -(1 << 30), weights).max(axis=1)
    wrong, least = int((own - others)[query].min()), int(own[query].min())
    return Bounds(int(own[query].sum()), wrong, least, wrong > 0 and least > 0 and scoring.gap_open > 0)


def gap_letters(loss: int, scoring: Scoring) -> int | None:
    """How many reference letters the gaps of an alignment can skip that loses so much; None if any number."""
    if loss < scoring.gap_open:
        return 0
    return (loss - scoring.gap_open) // scoring.gap_extend + 1 if scoring.gap_extend else None


def reach(query: str, score: int, m: int, scoring: Scoring) -> int:
    """Reference letters before an alignment's end, of m, that it can cover."""
    weights = np.array(scoring.weights, "i8")
    skipped = gap_letters(int(weights.max(axis=1)[encoded(query, scoring.alphabet)].clip(0).sum()) - score, scoring)
    return m if skipped is None else min(m, len(query) + skipped)


@lru_cache(2)
def words_of(reference: str, alphabet: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(letters of a word, all words of the reference as numbers in order, their places)."""
    size = min(12, int(31 * np.log(2) / np.log(len(alphabet))))
    codes = numbered(encoded(reference, alphabet), size, len(alphabet))
    order = codes.argsort(kind="stable").astype("u4")
    return size, codes[order], order


def numbered(letters: np.ndarray, size: int, base: int) -> np.ndarray:
    out = np.zeros(len(letters) - size + 1, "u4")
    for t in range(size):
        out = out * np.uint32(base) + letters[t : t + len(out)].astype("u4")
    return out


def seeded(query: str, reference: str, scoring: Scoring) -> tuple[int, int, int] | None:
    """What ``best_cells`` gives for a long reference, from the places where words of the query stand; None where that isn't proven.

    An alignment short of the query's most by some loss keeps all words of the query but those that a wrong letter, gap
    or clipped letter falls in, so few that the loss pays for: a wrong letter or gap spoils at most one word a letter of
    a word. One score found anywhere bounds the loss of the best. The words kept lie on diagonals that
    differ by the letters in gaps at most, so all stretches of the reference are swept that hold enough words so near.
    """
    q = encoded(query, scoring.alphabet)
    size, codes, places = words_of(reference, scoring.alphabet)
    known, words = bounds(q, scoring), len(q) - size + 1
    if words < 1 or not known.sure:
        return None
    own = numbered(q, size, len(scoring.alphabet))
    low, high = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
    counts = high - low
    total = int(counts.sum())
    if not 0 < total <= HITS:
        return None
    hits = np.arange(total) + np.repeat(low - np.cumsum(counts) + counts, counts)
    diagonals = np.sort(places[hits].astype("i8") - np.repeat(np.arange(words), counts))
    starts = np.flatnonzero(np.concatenate([[True], diagonals[1:] != diagonals[:-1]]))
    sizes = np.diff(np.append(starts, total))
    top = int(sizes.argmax())
    if sizes[top] == words:  # all of the query; of several places the first
        return capable(known.most), len(q), int(diagonals[starts[top]]) + len(q)
    near = int(diagonals[starts[top]])
    score = best_cells([query], [reference[max(0, near - 2 * BAND) : near + len(q) + 2 * BAND]], scoring)[0][0]
    loss = known.loss(score)
    skipped = gap_letters(loss, scoring)
    needed = words - max(size * loss // min(known.wrong, scoring.gap_open), loss // known.least)
    if skipped is None or needed < 1:
        return None
    last = np.arange(needed - 1, total)
    dense = last[diagonals[last] - diagonals[last - needed + 1] <= skipped]
    spans: list[list[int]] = []
    for a, b in zip((diagonals[dense - needed + 1] - skipped).tolist(), (diagonals[dense] + skipped + len(q)).tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([max(0, a), b])
    if not spans or any(b - a >= LONG for a, b in spans):
        return None
    found = best_cells([query] * len(spans), [reference[a:b] for a, b in spans], scoring)
    return min(((s, n, m + a) for (s, n, m), (a, _) in zip(found, spans)), key=lambda x: (-x[0], x[1], x[2]))


def banded(query: str, reference: str, score: int, scoring: Scoring) -> str:
    """The CIGAR of an alignment of both whole texts with this score, within the first band that holds one."""
    n, m, width = len(query), len(reference), BAND
    first, more = scoring.gap_open, scoring.gap_extend
    kind, low = cell_type(n, m, scoring)
    weights, q, r = weights_of(scoring, kind, low), encoded(query, scoring.alphabet), encoded(reference, scoring.alphabet)
    while True:
        shift, wide = min(0, m - n) - width, 2 * width + abs(m - n) + 1  # column k of row i is reference letter i + shift + k
        ramp = (more * np.arange(wide)).astype(kind)
        best, down, right = (np.full((n + 1, wide), low, kind) for _ in range(3))
        place = shift + np.arange(wide)
        top = (place >= 0) & (place <= m)
        best[0, top] = np.where(place[top] > 0, -first - more * (place[top] - 1), 0)
        right[0, top & (place > 0)] = best[0, top & (place > 0)]
        for i in range(1, n + 1):
            place += 1
            inside = (place >= 0) & (place <= m)
            down[i, :-1] = np.maximum(best[i - 1, 1:] - first, down[i - 1, 1:] - more)
            letters = np.where(inside & (place > 0), r[np.clip(place - 1, 0, m - 1)], len(scoring.alphabet))
            row = np.where(inside, np.maximum(down[i], best[i - 1] + weights[q[i - 1], letters]), low)
            right[i, 1:] = np.maximum.accumulate(row + ramp)[:-1] - first - ramp[1:] + more
            best[i] = np.where(inside, np.maximum(row, right[i]), low)
        end = m - n - shift
        if best[n, end] == score:
            return path(best, down, right, n, end, shift, first, more)
        if width > n + m:
            raise AssertionError("no band holds the alignment")
        width *= 2


def path(best: np.ndarray, down: np.ndarray, right: np.ndarray, i: int, k: int, shift: int, first: int, more: int) -> str:
    runs: list[list] = []
    state = "M"
    while state != "M" or i or i + shift + k:
        if state == "M":
            state = "D" if best[i, k] == right[i, k] else "I" if best[i, k] == down[i, k] else "M"
            op = "M" if state == "M" else ""
        else:
            op = state
        if op:
            if runs and runs[-1][1] == op:
                runs[-1][0] += 1
            else:
                runs.append([1, op])
        if op == "M":
            i -= 1
        elif op == "D":
            state = "D" if right[i, k] == right[i, k - 1] - more and right[i, k] != best[i, k - 1] - first else "M"
            k -= 1
        elif op == "I":
            state = "I" if down[i, k] == down[i - 1, k + 1] - more and down[i, k] != best[i - 1, k + 1] - first else "M"
            i, k = i - 1, k + 1
    return "".join(f"{n}{op}" for n, op in reversed(runs))


def padded(texts: list[str], alphabet: str) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), sizes.max()), len(alphabet), "i4")
    out[np.arange(out.shape[1]) < sizes[:, None]] = encoded("".join(texts), alphabet)
    return out


def swept(queries: list[str], references: list[str], scoring: Scoring) -> list[Found | None]:
    q, r = padded(queries, scoring.alphabet), padded(references, scoring.alphabet)
    count, n, m = len(q), q.shape[1], r.shape[1]
    kind, low = cell_type(n, m, scoring)
    weights = weights_of(scoring, kind, low)
    first, more = scoring.gap_open, scoring.gap_extend
    best, down, right = (np.zeros((n + 1, count, m + 1), kind) for _ in range(3))
    down[0], right[:] = low, low  # down ends in a query letter against a gap, right in a reference letter against one
    ramp = (more * np.arange(m + 1)).astype(kind)
    for i in range(1, n + 1):
        np.maximum(best[i - 1] - first, down[i - 1] - more, out=down[i])
        row = np.maximum(down[i], 0)
        row[:, 0] = 0
        np.maximum(row[:, 1:], best[i - 1, :, :-1] + weights[q[:, i - 1, None], r], out=row[:, 1:])
        right[i, :, 1:] = np.maximum.accumulate(row + ramp, axis=1)[:, :-1] - first - ramp[1:] + more
        np.maximum(row, right[i], out=best[i])
    return [traced(best[:, k], down[:, k], right[:, k], len(queries[k]), len(references[k]), first, more) for k in range(count)]


def traced(best: np.ndarray, down: np.ndarray, right: np.ndarray, n: int, m: int, first: int, more: int) -> Found | None:
    """The way back from the first best cell; gaps go before matches."""
    inner = best[: n + 1, : m + 1]
    end = int(inner.argmax())
    i, j = divmod(end, m + 1)
    score = capable(int(inner[i, j]))
    if score <= 0:
        return None
    runs: list[list] = [[n - i, "S"]]

    def step(op: str) -> None:
        if runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])

    state = "M"
    while state != "M" or best[i, j] > 0:
        if state == "M":
            here = best[i, j]
            if here == right[i, j]:
                state = "D"
            elif here == down[i, j]:
                state = "I"
            else:
                step("M")
                i, j = i - 1, j - 1
        elif state == "D":
            step("D")
            state = "D" if right[i, j] == right[i, j - 1] - more and right[i, j] != best[i, j - 1] - first else "M"
            j -= 1
        else:
            step("I")
            state = "I" if down[i, j] == down[i - 1, j] - more and down[i, j] != best[i - 1, j] - first else "M"
            i -= 1
    runs.append([i, "S"])
    return score, j, "".join(f"{k}{op}" for k, op in reversed(runs) if k)


def aligned_pairs(queries: list[str], references: list[str], scoring: Scoring, method: str) -> list[tuple | None]:
    """(score, ref_start, cigar) by one of METHODS, none for pairs that don't match."""
    if method == "scores":
        return [(score, None, None) if score > 0 else None for score in local_scores(queries, references, scoring)]
    return local_alignments(queries, references, scoring, method)


def turned(sequences: list[str]) -> list[str]:
    """The reverse complements."""
    known = {s: s and bases.complemented(s) for s in set(sequences)}
    return [known[s] for s in sequences]


def placed(sequences: list[str], refs: list[str], scoring: Scoring, method: str, rev_comp: bool) -> tuple[np.ndarray, np.ndarray | list[tuple | None]]:
    """(whether the reverse strand is better; (score, ref_start, cigar) of the better strand, none if nothing matches) of each query with
    each reference, references of a query side by side; by "scores" the scores alone, 0 if nothing matches."""
    if not rev_comp and method != "scores":
        return np.zeros(len(sequences) * len(refs), bool), aligned_pairs([s for s in sequences for _ in refs], refs * len(sequences), scoring, method)
    forward = score_table(sequences, refs, scoring).T.ravel()
    if not rev_comp:
        return np.zeros(len(forward), bool), forward
    back = turned(sequences)
    backward = score_table(back, refs, scoring).T.ravel()
    wins = backward > forward
    if method == "scores":
        return wins, np.maximum(forward, backward)
    strands = [x for pair in zip(sequences, back) for x in pair]
    at = np.repeat(np.arange(len(sequences)), len(refs)) * 2 + wins
    return wins, aligned_pairs([strands[k] for k in at.tolist()], refs * len(sequences), scoring, method)


def best_placed(sequences: list[str], refs: list[str], ranks: list, scoring: Scoring, method: str, rev_comp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | list[tuple | None]]:
    """(number of the reference, whether the reverse strand is better, (score, ref_start, cigar)) of each query's best reference, the one of
    highest rank of equals; only that one's way is looked for."""
    order = np.array(sorted(range(len(refs)), key=lambda k: ranks[k], reverse=True))
    forward = score_table(sequences, refs, scoring)
    back = turned(sequences) if rev_comp else sequences
    backward = score_table(back, refs, scoring) if rev_comp else forward
    scores = np.maximum(forward, backward)
    best, all_of = order[scores[order].argmax(axis=0)], np.arange(len(sequences))
    wins = backward[best, all_of] > forward[best, all_of]
    if method == "scores":
        return best, wins, scores[best, all_of]
    return best, wins, aligned_pairs([b if w else s for s, b, w in zip(sequences, back, wins.tolist())], [refs[k] for k in best.tolist()], scoring, method)


def columns_of(at: np.ndarray, wins: np.ndarray, found: np.ndarray | list[tuple | None]) -> list[pa.Array]:
    """The fields of PLACED."""
    strand = pa.DictionaryArray.from_arrays(pa.array(wins.astype("i4")), pa.array(["+", "-"])).cast(pa.string())
    if isinstance(found, np.ndarray):
        ways = pa.array(found, pa.int64(), mask=found == 0), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.string())
    else:
        columns = zip(*(x or UNMAPPED for x in found)) if found else ((), (), ())
        ways = (pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.string())))
    return [pa.array(at, pa.int32()), strand, *ways]


def align(queries: DataFrame, references: DataFrame, scoring: Scoring, rev_comp: bool = False, best_match: bool = False, method: str = "1pass") -> DataFrame:
    """Every query (ord, header, sequence, quality) against every reference (ref_ord, name, ref): strand, score, ref_start, cigar.

    Unmapped pairs have a null score. ``rev_comp`` also aligns the query's reverse complement, which wins if strictly
    better; ``best_match`` keeps a query's best reference, the last of equals. ``method`` is one of METHODS: "3pass" for
    long references, "scores" where starts and CIGARs are not needed and stay null. The references' letters are
    counted: within BROADCAST_LETTERS they go to all tasks, and queries travel without them. Beyond that both sides are cut into blocks and each block of
    queries meets each block of references in one task, which keeps only the best of its references for ``best_match``.
    """
    if method not in METHODS:
        raise ValueError(f"the method is one of {', '.join(METHODS)}")
    if rev_comp and scoring.alphabet != DNA:
        raise ValueError("only DNA has a reverse complement")
    size = references.agg(F.sum(F.length("ref")).alias("n")).first()["n"] or 0
    if size > BROADCAST_LETTERS:
        return gridded(queries, references, scoring, rev_comp, best_match, method, -(-size // BROADCAST_LETTERS))
    known = references.select("ref_ord", "name", "ref").orderBy("ref_ord", "name").collect()  # of BROADCAST_LETTERS at most
    spark = queries.sparkSession
    texts = spark.sparkContext.broadcast(([r["ref"] or "" for r in known], [r["ref_ord"] for r in known]))
    kind = pa.struct([("at", pa.int32()), ("strand", pa.string()), ("score", pa.int64()), ("ref_start", pa.int32()), ("cigar", pa.string())])

    @arrow_udf(PLACED)
    def best(sequences: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(columns_of(*best_placed(sequences.to_pylist(), *texts.value, scoring, method, rev_comp)), fields=list(kind))

    @arrow_udf(f"array<{PLACED}>")
    def each(sequences: pa.Array, blocks: pa.Array) -> pa.Array:
        refs, own = texts.value[0], sequences.to_pylist()
        numbers = blocks.to_numpy()
        sizes = np.minimum(len(refs), (numbers + 1) * BLOCK) - numbers * BLOCK
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        parts, places = [], []
        for b in np.unique(numbers).tolist():
            rows, span = np.flatnonzero(numbers == b), range(b * BLOCK, min(len(refs), (b + 1) * BLOCK))
            places.append((cuts[rows][:, None] + np.arange(len(span))).ravel())
            ways = placed([own[i] for i in rows.tolist()], [refs[k] for k in span], scoring, method, rev_comp)
            parts.append(pa.record_batch(columns_of(np.tile(span, len(rows)), *ways), names=[f.name for f in kind]))
        found = pa.Table.from_batches(parts, pa.schema(list(kind))).combine_chunks()
        if len(parts) > 1:
            found = found.take(np.argsort(np.concatenate(places)))
        columns = [c.combine_chunks() for c in found.columns]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))

    own = ["ord", "header", "sequence", "quality"]
    names = StructType([StructField("at", IntegerType()), references.schema["ref_ord"], StructField("name", StringType()), StructField("ref_length", IntegerType())])
    named_refs = spark.createDataFrame([(k, r["ref_ord"], r["name"], None if r["ref"] is None else len(r["ref"])) for k, r in enumerate(known)], names)
    if best_match:
        found = queries.where(F.lit(bool(known))).select(*own, best("sequence").alias("x"))
    else:
        blocks = spark.range(0, -(-len(known) // BLOCK), 1, 1).select(F.col("id").cast("int").alias("block"))
        found = queries.crossJoin(F.broadcast(blocks)).select(*own, F.explode(each("sequence", "block")).alias("x"))  # asked for: each query against each reference
    # (an inner join's filter of nulls would look for all of it a second time)
    return found.select(*own, "x.*").join(F.broadcast(named_refs), "at", "left").select(*own, "ref_ord", "name", "ref_length", "strand", "score", "ref_start", "cigar")


def gridded(queries: DataFrame, references: DataFrame, scoring: Scoring, rev_comp: bool, best_match: bool, method: str, columns: int) -> DataFrame:
    """``align`` for references of any size: a grid of blocks, each a group of at most LINE_LETTERS letters of queries and
    about BROADCAST_LETTERS of references.

    Each query is sent to every block of references and each reference to every block of queries, which is all that
    is shuffled; products are made inside of tasks. With ``best_match`` a task gives a query's best reference of its block,
    and only those meet.
    """
    letters = queries.agg(F.sum(F.length("sequence") + 1).alias("n")).first()["n"] or 0
    lines = max(1, -(-letters // LINE_LETTERS))
    own = [f for f in queries.schema.fields if f.name in ("ord", "header", "sequence", "quality")]
    lines = max(1, -(-letters // LARGEST_LINE), min(lines, 4 * queries.sparkSession.sparkContext.defaultParallelism))
    block = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("long")
    q = queries.select(*(f.name for f in own), block(["ord", "header"], lines).alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")).alias("column"))
    r = references.select("ref_ord", "name", "ref", block(["ref_ord", "name"], columns).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1)).cast("array<bigint>")).alias("line"))
    ref_type = references.schema["ref_ord"].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", ref_ord {ref_type}, name string, ref_length int, strand string, score bigint, ref_start int, cigar string"

    def cell(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        known = right.to_pylist()
        for batch in left.select([f.name for f in own]).to_batches(max_chunksize=max(1, CELL_PAIRS // max(1, len(known)))):
            rows = batch.to_pylist()
            sequences, refs = [row["sequence"] for row in rows], [ref["ref"] for ref in known]
            if best_match:
                at, *ways = best_placed(sequences, refs, [ref["ref_ord"] for ref in known], scoring, method, rev_comp)
            else:
                at, ways = np.tile(np.arange(len(known)), len(rows)), placed(sequences, refs, scoring, method, rev_comp)
            _, *found = columns_of(at, *ways)
            side = right.select(["ref_ord", "name"]).take(at).combine_chunks()
            lengths = np.array([len(ref) for ref in refs], "i4")[at]
            names = ["ref_ord", "name", "ref_length", "strand", "score", "ref_start", "cigar"]
            more = [*(c.combine_chunks() for c in side.columns), pa.array(lengths), *found]
            owners = pa.array(np.repeat(np.arange(len(rows)), len(at) // len(rows)), pa.int64())
            yield pa.record_batch([*batch.take(owners).columns, *more], names=[*batch.schema.names, *names])

    def tables(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(cell(left, right)) if right.num_rows else []
        return pa.Table.from_batches(batches) if batches else pa.table({name: pa.array([], kind) for name, kind in zip(arrow.names, arrow.types)})

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    done = q.groupBy("line", "column").cogroup(r.groupBy("line", "column")).applyInArrow(tables, schema)
    return best_of(done) if best_match else done


def best_of(alignments: DataFrame) -> DataFrame:
    rest = F.struct(*(c for c in alignments.columns if c != "ord"))
    return alignments.groupBy("ord").agg(F.max_by(rest, F.struct(F.coalesce("score", F.lit(0)), "ref_ord")).alias("x")).select("ord", "x.*")


def sam_rows(alignments: DataFrame, exclude_unmapped: bool = False) -> DataFrame:
    """(ord, ref_ord, line): alignments as SAM lines; reverse strands show the reverse complement, flag 16."""
    mapped = F.col("score") > 0
    back = F.col("strand") == "-"
    quality = F.coalesce(F.when(back, F.reverse("quality")).otherwise(F.col("quality")), F.lit("*"))
    name = headers.first_token(F.col("header"))
    hit = F.concat_ws("\t", name, F.when(back, F.lit("16")).otherwise(F.lit("0")), headers.first_token(F.col("name")), (F.col("ref_start") + 1).cast("string"), F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.when(back, bases.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")), quality, F.concat(F.lit("AS:i:"), F.col("score").cast("string")))
    miss = F.concat_ws("\t", name, F.lit("4"), *map(F.lit, ("*", "0", "255", "*", "*", "0", "0", "*", "*")))
    rows = alignments.where(mapped) if exclude_unmapped else alignments
    return rows.select("ord", "ref_ord", F.when(mapped, hit).otherwise(miss).alias("line"))


def sam_header(references: DataFrame) -> DataFrame:
    """(row, line): the version line and one line per reference, in order."""
    lines = references.select((F.col("ref_ord") + 1).cast("long").alias("row"), F.concat(F.lit("@SQ\tSN:"), headers.first_token(F.col("name")), F.lit("\tLN:"), F.length("ref").cast("string")).alias("line"))
    return references.sparkSession.range(1).select(F.lit(0).cast("long").alias("row"), F.lit("@HD\tVN:1.4").alias("line")).unionByName(lines)


def tallies(queries: DataFrame, references: DataFrame, alignments: DataFrame, rev_comp: bool = False) -> DataFrame:
    """One row of six counts, for ``alignments`` of each query with each reference; with ``rev_comp`` each pair counts twice and the
    losing strand as fitting. What is asked of the queries is counted among the alignments, without a second look at them."""
    double = 2 if rev_comp else 1
    known = references.agg(F.count(F.lit(1)).alias("references"), F.min_by(F.length("ref"), "ref_ord").cast("long").alias("first_reference_length")).first()
    short, lot = F.sum((F.length("sequence") <= 300).cast("long")), F.lit(known["references"]).cast("long")
    told = [lot.alias("references"), F.lit(known["first_reference_length"]).cast("long").alias("first_reference_length")]
    if not known["references"]:  # nothing to be aligned with
        a = queries.agg(F.count(F.lit(1)).alias("queries"), short.alias("queries_at_most_300"))
        return a.select("*", *told, F.lit(0).cast("long").alias("alignments"), F.lit(None).cast("long").alias("scores_fitting"))
    fits = (F.coalesce("score", F.lit(0)) <= FITTING).cast("long")
    n = F.count(F.lit(1))
    c = alignments.agg(n.alias("n"), short.alias("short"), F.sum(fits).alias("fits"))
    whole = lambda name: F.expr(f"{name} div {known['references']}")
    return c.select(whole("n").alias("queries"), whole("short").alias("queries_at_most_300"), *told, (F.col("n") * double).alias("alignments"), (F.col("fits") + (F.col("n") if rev_comp else F.lit(0))).alias("scores_fitting"))
