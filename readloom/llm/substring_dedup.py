"""Substring de-duplication: normalised units of lines, digests grouped globally, the earliest occurrence kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import bloom, common
from readloom.llm.line_dedup import earliest, foreign, row_of

#: A unit ends with its line, with its sentence, or after a word chosen by its own hash (one word in CUT_EVERY), so that a
#: passage is cut alike wherever it stands; so that no unit is shorter than LEAST_WORDS, ends that come earlier don't count.
CUT_EVERY = 4
LEAST_WORDS = 3
#: Of a word said over and over, every SAID_OVER repeats make an end.
SAID_OVER = 4
#: Runs of repeated units go from so many words on: passages of 50 words, less what their cut ends may lose.
MIN_WORDS = 40
WORD = re.compile(r"\S+")
#: Words, up to LONGEST letters, whose choice a Python worker remembers; beyond that it forgets all and begins anew.
REMEMBERED, LONGEST = 200_000, 256


class Chosen(dict):
    """word -> whether a unit may end after it."""

    def __missing__(self, word: str) -> bool:
        if len(self) > REMEMBERED:
            self.clear()
        out = word[-1] in ".!?" or not crc32(word.encode("utf-8")) % CUT_EVERY
        if len(word) <= LONGEST:
            self[word] = out
        return out


CHOSEN = Chosen()


def ends_of(lines: list[list[str]]) -> list[int]:
    """Where the units of a text end, counted in words; ``lines`` are the lower-cased words of its lines.

    What is left at the end of the text, under LEAST_WORDS words, belongs to the last unit.
    """
    out, at, begun, before, said = [], 0, 0, "", 0
    for words in lines:
        for n, (word, chosen) in enumerate(zip(words, map(CHOSEN.__getitem__, words)), at + 1):
            if word == before:
                said += 1
                if not said % SAID_OVER:
                    chosen = True
            elif said:
                said = 0
            before = word
            if chosen and n - begun >= LEAST_WORDS:
                out.append(n)
                begun = n
        at += len(words)
        if at - begun >= LEAST_WORDS:
            out.append(at)
            begun = at
    if begun < at:
        out[-1:] = [at]
    return out


def units(text: str) -> tuple[list[int], list[bytes]]:
    """The ends of the units of ``text`` in words, and their digests: of the lower-cased words with single spaces."""
    lines = [line.split() for line in text.lower().split("\n")]
    ends = ends_of(lines)
    words = [w for line in lines for w in line]
    digest = xxhash.xxh3_128_digest
    return ends, [digest(" ".join(words[s:e]).encode("utf-8")) for s, e in zip([0, *ends], ends)]


def removed_spans(text: str, repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of the runs of repeated units of at least ``min_words`` words; the white space after goes too."""
    ends = ends_of([line.split() for line in text.lower().split("\n")])
    runs, i = [], 0
    while i < len(ends):
        j = i
        while j < len(ends) and j in repeated:
            j += 1
        if j > i:
            first = ends[i - 1] if i else 0
            if ends[j - 1] - first >= min_words:
                runs.append((first, ends[j - 1]))
        i = max(j, i + 1)
    if not runs:
        return []
    starts = [m.start() for m in WORD.finditer(text)]
    starts[0] = 0
    starts.append(len(text))
    return [(starts[s], starts[e]) for s, e in runs]


def digested(within: bool, known: Broadcast | None = None):
    """Over rows (doc, mark, text): (doc, mark, place, d1, d2), 96 bits of the digest of every unit, or of those whose d1
    the filter ``known`` holds or that their own text had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, digests = [], [], []
            for value in batch.column(2):
                _, own = units(value.as_py())
                if within:  # twice the unit, and 1 if its own text had it before
                    seen: set[bytes] = set()
                    places += [2 * i + (d in seen or seen.add(d) is not None) for i, d in enumerate(own)]
                else:
                    places += range(0, 2 * len(own), 2)
                digests += own
                counts.append(len(own))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner, places = np.repeat(np.arange(len(counts)), np.array(counts, "i8")), np.array(places, "i4")
            if known is not None:
                asked = np.flatnonzero(known.value.holds(halves[:, 0].view("u8")) | (places % 2 == 1))
                owner, places, halves = owner[asked], places[asked], halves[asked]
            yield pa.record_batch(
                [pa.array(batch.column(i).to_numpy()[owner]) for i in (0, 1)] + [pa.array(places), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].astype("i4"))],
                names=["doc", "mark", "place", "d1", "d2"],
            )

    return run


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """(doc, mark, unit) of every unit whose digest stands in a document that ranks earlier, or, with ``within``, earlier
    in its own text. ``mark`` tells the texts of one document apart. Digests are combined before they are shuffled; the
    repeated ones make a Bloom filter, and only units that it holds are shuffled to be joined with them."""
    common.bounded_batches(docs.sparkSession)
    own = docs.select(*row_of(docs, key, text, "doc", "mark"), common.text_of(text).alias("text"))
    kinds = "doc bigint, mark bigint, place int, d1 bigint, d2 int"
    often = earliest(own.mapInArrow(digested(within), kinds), "d1", "d2").withColumnsRenamed({"d1": "e1", "d2": "e2"})
    often = common.durable(often)  # so that the join's hot digests can be split
    known = docs.sparkSession.sparkContext.broadcast(bloom.seen(often.select("e1")))
    every = own.mapInArrow(digested(within, known), kinds)
    found = every.join(often, (every.d1 == often.e1) & (every.d2 == often.e2), "left" if within else "inner")
    return found.where(foreign() | (F.col("place") % 2 == 1)).select("doc", "mark", F.shiftright("place", 1).alias("unit"))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """``docs`` with kept_text and removed, an array of (start, end) code points in the original text; clashes append underscores.

    Units are lines and content-defined parts of lines, lower-cased with white space made one space; the whole text
    belongs to units. Of equal units in several documents the one with the smallest ``key`` keeps its own; in all others
    runs of such units of at least ``min_words`` words go (1 removes every later repeat) and are reported with their
    offsets. What one document says twice stays, unless ``within``: then the smallest place keeps it. Null texts read as
    empty; texts under LEAST_WORDS words are one unit. Rows that repeat a key are one document, each with the result of its
    own text; rows without a key come after all others, each text a document of its own, equal ones alike. No row is lost.
    """
    drops = repeated_units(docs, key, text, within).groupBy("doc", "mark").agg(F.collect_set("unit").alias("drops"))
    own, mark, gone, kept, other, other_mark = common.fresh(docs, "_doc", "_mark", "_gone", "_kept", "_other", "_other_mark")
    drops = drops.select(F.col("doc").alias(other), F.col("mark").alias(other_mark), F.col("drops").alias(gone))

    @arrow_udf("struct<text:string,removed:array<struct<start:bigint,end:bigint>>>")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out, spans, offsets = [], [], [0]
        for value, lost in zip(texts, drops):
            value, lost = value.as_py(), lost.as_py()
            own = removed_spans(value, set(lost), min_words) if lost else []
            parts, at = [], 0
            for s, e in own:
                parts.append(value[at:s])
                at = e
            parts.append(value[at:])
            out.append("".join(parts))
            spans += own
            offsets.append(len(spans))
        pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], ["start", "end"])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["text", "removed"])

    joined = docs.select("*", *row_of(docs, key, text, own, mark)).join(drops, (F.col(own) == F.col(other)) & (F.col(mark) == F.col(other_mark)), "left")
    joined = joined.withColumn(kept, without(common.text_of(text), F.col(gone)))
    names = common.fresh(docs, "kept_text", "removed")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{kept}.{f}").alias(n) for f, n in zip(("text", "removed"), names)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the kept text, the spans taken out, and how many there are."""
    out = dedup_substrings(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed").alias("n_removed"), "removed", F.col("kept_text").alias("text"))
