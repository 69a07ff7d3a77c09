"""The trim steps as SQL for the second engine, step by step over (s, lo, hi); used only to check results."""

from __future__ import annotations

from readloom.functions.bases import complemented
from readloom.plans.views import READS_SQL

VIEW = "substring(s, lo + 1, hi - lo)"


class Steps:
    """A chain of common table expressions; each takes the one before."""

    def __init__(self, preserve: bool = False, mask: bool = False, source: str = READS_SQL) -> None:
        self.mask = mask
        s = "sequence" if preserve else "upper(regexp_replace(sequence, '[^ACGTNacgtn]', 'N', 'g'))"
        self.parts = [f"SELECT *, {s} AS s, CAST(0 AS BIGINT) AS lo, CAST(length(sequence) AS BIGINT) AS hi, length(sequence) AS full_length FROM ({source})"]
        self.flags = ""

    def add(self, query: str) -> "Steps":
        self.parts.append(query.replace("PREV", f"c{len(self.parts) - 1}"))
        return self

    def shrink(self, extra: str, lo: str, hi: str) -> "Steps":
        """New window (lo, hi) from columns ``extra`` computed first; masked if asked for."""
        s = "substring(s, 1, lo) || repeat('N', l_ - lo) || substring(s, l_ + 1, h_ - l_) || repeat('N', hi - h_) || substring(s, hi + 1)" if self.mask else "s"
        self.add(f"SELECT *, {extra} FROM PREV")
        self.add(f"SELECT *, CAST({lo} AS BIGINT) AS l_, CAST({hi} AS BIGINT) AS h_ FROM PREV")
        return self.add(f"SELECT * EXCLUDE (l_, h_, n_, b_) REPLACE (l_ AS lo, h_ AS hi, {s} AS s) FROM PREV")

    def flagged(self, name: str) -> "Steps":
        return self.add(f"SELECT * EXCLUDE (was_), hi - lo < was_ AS trimmed_{name} FROM PREV")

    def start(self) -> "Steps":
        return self.add("SELECT *, hi - lo AS was_ FROM PREV")

    def polyg(self, left: int | None, right: int | None) -> "Steps":
        if left is not None:
            self.shrink(f"length(regexp_extract({VIEW}, '^G*')) AS n_, 0 AS b_", f"CASE WHEN n_ >= {left} THEN lo + n_ ELSE lo END", "hi")
        if right is not None:
            self.shrink(f"length({VIEW}) - length(regexp_replace({VIEW}, 'G+$', '')) AS n_, 0 AS b_", "lo", f"CASE WHEN n_ >= {right} THEN hi - n_ ELSE hi END")
        return self

    def adapter(self, forward: str, fuzzy: bool) -> "Steps":
        back, n = complemented(forward), len(forward)
        tries = [find(VIEW, back), find(VIEW, forward)] + ([find(VIEW, back, 1), find(VIEW, forward, 1)] if fuzzy else ["0", "0"])
        self.add("SELECT *, " + ", ".join(f"{t} AS t{i}_" for i, t in enumerate(tries)) + " FROM PREV")
        self.add("SELECT * EXCLUDE (t0_, t1_, t2_, t3_), CASE WHEN t0_ > 0 THEN t0_ WHEN t1_ > 0 THEN t1_ WHEN t2_ > 0 THEN t2_ ELSE t3_ END AS at_, t0_ > 0 OR (t1_ = 0 AND t2_ > 0) AS back_ FROM PREV")
        if self.mask:
            return self.add(f"SELECT * EXCLUDE (at_, back_) REPLACE (CASE WHEN at_ > 0 THEN substring(s, 1, lo + at_ - 1) || repeat('N', {n}) || substring(s, lo + at_ + {n}) ELSE s END AS s) FROM PREV")
        return self.add(f"SELECT * EXCLUDE (at_, back_) REPLACE (CASE WHEN at_ > 0 AND NOT back_ THEN lo + at_ - 1 + {n} ELSE lo END AS lo, CASE WHEN at_ > 0 AND back_ THEN lo + at_ - 1 ELSE hi END AS hi) FROM PREV")

    def barcode(self, code: str, d: int, left: int | None, right: int | None) -> "Steps":
        n = len(code)
        if left != 0:
            v = VIEW if left is None else f"substring(s, lo + 1, least(hi - lo, {left}))"
            self.shrink(f"{find(v, code, d)} AS n_, 0 AS b_", f"CASE WHEN n_ > 0 THEN lo + n_ - 1 + {n} ELSE lo END", "hi")
        if right != 0:
            b = "lo" if right is None else f"greatest(lo, hi - {right})"
            v = f"substring(s, ({b}) + 1, hi - ({b}))"
            self.shrink(f"{find(v, complemented(code), d)} AS n_, {b} AS b_", "lo", "CASE WHEN n_ > 0 THEN b_ + n_ - 1 ELSE hi END")
        return self

    def primer(self, side: str, window: int, kmers: frozenset[str], k: int) -> "Steps":
        known = ", ".join(f"'{m}'" for m in sorted(kmers))
        size = f"least(hi - lo, {window})"
        b = "lo" if side == "left" else f"hi - {size}"
        self.add(f"SELECT *, {b} AS b_, {size} AS z_ FROM PREV")
        self.add(f"SELECT *, list_filter(range(0, z_ - {k} + 1), lambda i: substring(s, b_ + i + 1, {k}) IN ({known})) AS hits_ FROM PREV")
        if self.mask:
            letters = f"list_transform(range(0, CAST(length(s) AS BIGINT)), lambda x: CASE WHEN len(list_filter(hits_, lambda i: x >= b_ + i AND x < b_ + i + {k})) > 0 THEN 'N' ELSE substring(s, x + 1, 1) END)"
            return self.add(f"SELECT * EXCLUDE (b_, z_, hits_) REPLACE (CASE WHEN len(hits_) > 0 THEN array_to_string({letters}, '') ELSE s END AS s) FROM PREV")
        if side == "left":
            return self.add(f"SELECT * EXCLUDE (b_, z_, hits_) REPLACE (CASE WHEN len(hits_) > 0 THEN b_ + list_max(hits_) + {k} ELSE lo END AS lo) FROM PREV")
        return self.add("SELECT * EXCLUDE (b_, z_, hits_) REPLACE (CASE WHEN len(hits_) > 0 THEN b_ + list_min(hits_) ELSE hi END AS hi) FROM PREV")

    def hard(self, left: int, right: int) -> "Steps":
        return self.shrink("0 AS n_, 0 AS b_", f"CASE WHEN hi - lo <= {left + right} THEN lo ELSE lo + {left} END", f"CASE WHEN hi - lo <= {left + right} THEN lo ELSE hi - {right} END")

    def sql(self, select: str, tail: str = "") -> str:
        ctes = ", ".join(f"c{i} AS MATERIALIZED ({p})" for i, p in enumerate(self.parts))
        return f"WITH {ctes} SELECT {select} FROM c{len(self.parts) - 1} {tail}"

    def result(self) -> str:
        """ord, sequence and quality as the trimmed reads have them."""
        if self.mask:
            return self.sql("ord, s AS sequence, quality")
        return self.sql(f"ord, {VIEW} AS sequence, substring(quality, lo + 1, hi - lo) AS quality")


def find(v: str, pattern: str, d: int = 0) -> str:
    n = len(pattern)
    if d == 0:
        return f"instr({v}, '{pattern}')"
    return f"coalesce(list_filter(range(1, length({v}) - {n} + 2), lambda i: hamming(substring({v}, i, {n}), '{pattern}') <= {d})[1], 0)"
