"""Columns over read headers: molecule and side, merged names, and the repair of archive headers.

A header speaks one of these dialects, tried in this order: with a space, sequencer style ("id side:...") unless the
id is an archive accession with a dot, then the side follows a second dot or is missing; without a space, "id/side",
then the archive style with underscores, then a side after an underscore in the seventh colon field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE = "^(SRR|DRR|ERR)"


def dots(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))


def after(s: Column, head: Column) -> Column:
    """What follows the leading part ``head`` of ``s``."""
    return F.substring(s, F.length(head) + 1, F.length(s))


def fields(s: Column) -> tuple[Column, Column, Column, Column]:
    """The seventh colon field (null unless a colon ends it), the text before it, and what precedes and follows its underscore."""
    parts = F.split(s, ":")
    seventh = F.when(F.size(parts) >= 8, F.get(parts, F.lit(6)))
    before = F.concat_ws(":", F.slice(parts, 1, 6))
    return seventh, before, F.substring_index(seventh, "_", 1), parts


def molecule(s: Column, default: str = "0") -> Column:
    """struct(id, side) of a header; null where no dialect fits. A side outside 0 to 3 is the default."""
    first = F.substring_index(s, " ", 1)
    token = F.get(F.split(s, " "), F.lit(1))
    bare = F.substring_index(s, "_", 1)
    slash = F.substring_index(s, "/", 1)
    seventh, before, stem, _ = fields(s)

    def archive(name: Column) -> tuple[Column, Column]:
        two = F.substring_index(name, ".", 2)
        sided = dots(name) >= 2
        return F.when(sided, two).otherwise(name), F.when(sided, F.substring(name, F.length(two) + 2, F.lit(1))).otherwise(F.lit(default))

    spaced = F.contains(s, F.lit(" "))
    is_archive = lambda x: x.rlike(ARCHIVE) & F.contains(x, F.lit("."))
    spaced_id, spaced_side = archive(first)
    bare_id, bare_side = archive(bare)
    cases = [
        (spaced & ~is_archive(first), first, F.substring(F.substring_index(token, ":", 1), 1, 1)),
        (spaced, spaced_id, spaced_side),
        (F.contains(s, F.lit("/")), slash, F.substring(s, F.length(slash) + 2, F.lit(1))),
        (is_archive(s), bare_id, bare_side),
        (F.contains(seventh, F.lit("_")), F.concat(before, F.lit(":"), stem), F.right(seventh, F.lit(1))),
    ]
    out = None
    for when, name, side in cases:
        one = F.struct(name.alias("id"), F.when(side.isin("0", "1", "2", "3"), side).otherwise(F.lit(default)).alias("side"))
        out = F.when(when, one) if out is None else out.when(when, one)
    return out


def merged_name(s: Column) -> Column:
    """The name of a merged pair: the side becomes 3 in the header's own dialect; other headers stay as they are."""
    first = F.substring_index(s, " ", 1)
    tail = after(s, first)
    bare = F.substring_index(s, "_", 1)
    seventh, before, stem, parts = fields(s)
    is_archive = lambda x: x.rlike(ARCHIVE) & F.contains(x, F.lit("."))
    rest = F.concat_ws(":", F.slice(parts, F.lit(8), F.size(parts)))
    return (
        F.when(F.contains(s, F.lit(" ")) & ~is_archive(first), F.concat(first, F.lit(" 3"), F.when(F.contains(tail, F.lit(":")), after(tail, F.substring_index(tail, ":", 1))).otherwise(F.lit(""))))
        .when(F.contains(s, F.lit(" ")), F.concat(F.substring_index(first, ".", 2), F.lit(".3"), tail))
        .when(F.contains(s, F.lit("/")), F.concat(F.substring_index(s, "/", 1), F.lit("/3")))
        .when(is_archive(s), F.concat(F.substring_index(bare, ".", 2), F.lit(".3"), after(s, bare)))
        .when(F.contains(seventh, F.lit("_")), F.concat(before, F.lit(":"), stem, F.lit("_3:"), rest))
        .otherwise(s)
    )


def repaired(s: Column, side: Column | None) -> Column:
    """Archive headers without a side get ``.side`` after the id; no side, no change."""
    if side is None:
        return s
    name = F.when(F.contains(s, F.lit(" ")), F.substring_index(s, " ", 1)).otherwise(F.substring_index(s, "_", 1))
    return F.when(name.rlike(ARCHIVE) & (dots(name) == 1) & side.isNotNull(), F.concat(name, F.lit("."), side.cast("string"), after(s, name))).otherwise(s)


def same_molecule(a: Column, b: Column) -> Column:
    """Whether two headers name one molecule, sides ignored; false where one of them can't be read."""
    return F.coalesce(molecule(a)["id"] == molecule(b)["id"], F.lit(False))


def first_token(s: Column) -> Column:
    """A header up to its first white space; * if nothing is there."""
    token = F.regexp_extract(s, r"^\s*(\S+)", 1)
    return F.when(token == "", F.lit("*")).otherwise(token)


def without_tabs(s: Column) -> Column:
    return F.translate(s, "\t", " ")
