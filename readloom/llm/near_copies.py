"""Near copies by exact Jaccard similarity: candidates of SimHash and of min-hash bands, every link verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common
from readloom.llm.line_dedup import LAST
from readloom.llm.simhash import links, majority, shingle_hashes
from readloom.runtime import forget

#: Texts that share j of their shingles meet in a band with probability 1 - (1 - j ** ROWS) ** BANDS: 0.998 for 0.8.
BANDS, ROWS = 20, 6
#: Shares of equal min-hashes from which a text leaves a band's search, and from which its closest leader is verified at all.
SURE, WORTH = 0.8, 0.6
#: Texts of one band that one task holds against each other.
GROUP = 1 << 12
#: Documents whose numbers are broadcast, to read their texts without a shuffle of all texts.
BROADCAST_IDS = 1_000_000
#: Shingles that are permuted at once.
BLOCK = 1 << 12
DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * ROWS), "u8")
FACTORS, SHIFTS, MIXED = DRAWN[0] * np.uint64(2) + np.uint64(1), DRAWN[1], DRAWN[2] * np.uint64(2) + np.uint64(1)


def min_hashes(hashes: list[int]) -> np.ndarray:
    values, out = np.array(hashes, "u8"), np.full(BANDS * ROWS, (1 << 64) - 1, "u8")
    for s in range(0, len(values), BLOCK):
        np.minimum(out, (values[s : s + BLOCK, None] * FACTORS + SHIFTS).min(axis=0), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    return (((mins >> np.uint64(7)) * MIXED).reshape(BANDS, ROWS).sum(axis=1, dtype="u8") + np.arange(BANDS, dtype="u8")).view("i8")


def text_mark(text: str) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8").lower().split()))


def signed(docs: DataFrame, words_each: int) -> DataFrame:
    """(id, mark, fp, bands, sketch) of rows (id, text); texts of the same words have the same mark."""
    common.bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, prints, bands, sketches = [], [], [], []
            for value in batch.column(1):
                value = value.as_py()
                hashes = shingle_hashes(value, words_each)
                mins = min_hashes(hashes)
                marks.append(text_mark(value))
                prints.append(majority(hashes, [len(hashes)]))
                bands.append(band_keys(mins))
                sketches.append((mins >> np.uint64(32)).astype("u1").tobytes())
            offsets = pa.array(np.arange(len(marks) + 1, dtype="i4") * BANDS)
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, "i8"), *bands])))
            fps = pa.array(np.concatenate([np.zeros(0, "u8"), *prints]).view("i8"))
            yield pa.record_batch([batch.column(0), pa.array(marks, pa.binary()), fps, keys, pa.array(sketches, pa.binary())], names=["id", "mark", "fp", "bands", "sketch"])

    return docs.mapInArrow(sign, "id bigint, mark binary, fp bigint, bands array<bigint>, sketch binary")


def marked(text: Column) -> Column:
    @arrow_udf("binary")
    def mark(values: pa.Array) -> pa.Array:
        return pa.array([text_mark(v.as_py()) for v in values], pa.binary())

    return mark(text)


def leaders(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(closest, leads) of a group's texts in order: the first leads all that are surely like it, the first of the others
    leads next, and so on. ``closest`` is the most similar leader, -1 if none is worth a look; a member that is not surely
    like any leader leads itself."""
    rest, best, closest = np.arange(len(sketches)), np.full(len(sketches), WORTH), np.full(len(sketches), -1)
    leads = np.zeros(len(sketches), bool)
    while len(rest):
        lead, rest = rest[0], rest[1:]
        leads[lead] = True
        alike = (sketches[rest] == sketches[lead]).mean(axis=1)
        better = alike >= best[rest]
        best[rest[better]], closest[rest[better]] = alike[better], lead
        rest = rest[alike < SURE]
    return closest, leads


LED = "band bigint, first bigint, mark binary, sketch binary, leader binary, before bigint"


def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (band, part, first, mark, sketch, n, last) sorted by band and part: members with their leader, to be
    verified, and, where the band goes on (not ``last``), the leaders, with ``n`` as before."""
    now, held = None, []

    def told() -> pa.RecordBatch:
        closest, leads = leaders(np.frombuffer(b"".join(r[4] for r in held), "u1").reshape(-1, BANDS * ROWS))
        out = [(r[0], r[2], r[3], None, held[c][3], None) for r, c in zip(held, closest) if c >= 0]
        out += [(r[0], r[2], r[3], r[4], None, r[5]) for r, own in zip(held, leads) if own and not r[6]]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["band", "first", "mark", "sketch", "leader", "before"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                if len(held) > 1 or held and not held[0][6]:
                    yield told()
                now, held = row[:2], []
            held.append(row)
    if len(held) > 1 or held and not held[0][6]:
        yield told()


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b) to verify, of rows (band, first, mark, sketch): members and their leaders.

    A band of over GROUP texts is dealt into parts of about GROUP; the leaders of its parts go on to the next round. If
    they are over half of what they were and still over GROUP, each two parts of the band are held against each other
    instead, which ends it. So no task takes more than two parts, and texts are left out of no band.
    """
    found, turn, rows = [], 0, banded.withColumn("before", F.lit(None).cast("long"))
    while True:
        hot = common.durable(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP))
        if hot.isEmpty():
            dealt = rows.select("band", F.lit(0).cast("long").alias("part"), "first", "mark", "sketch", F.lit(None).cast("long").alias("n"), F.lit(True).alias("last"))
        else:
            parts, part = F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)), F.pmod(F.xxhash64("mark", F.lit(turn)), F.col("parts"))
            stalled = F.coalesce(F.col("n") * 2 > F.col("before"), F.lit(False))
            sized = rows.join(hot, "band", "left").withColumn("parts", parts).withColumn("part", part).withColumn("stalled", stalled)
            both = F.expr("transform(sequence(0L, parts - 1), k -> least(k, part) * parts + greatest(k, part))")
            sized = sized.withColumn("part", F.explode(F.when(F.col("stalled"), both).otherwise(F.array(F.col("part") * F.col("parts") + F.col("part")))))
            dealt = sized.select("band", "part", "first", "mark", "sketch", "n", (F.col("stalled") | F.col("n").isNull()).alias("last"))
        done = dealt.repartition("band", "part").sortWithinPartitions("band", "part", "first", "mark").mapInArrow(led, LED)
        if hot.isEmpty():
            found.append(done)
            break
        done = common.durable(done)
        found.append(done)
        rows = done.where("leader is null").select("band", "first", "mark", "sketch", "before")
        if rows.isEmpty():
            break
        turn += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where("leader is not null").select(F.col("leader").alias("a"), F.col("mark").alias("b"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 5, least: float = 0.8, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the smallest ``key``, with all its columns.

    Texts of the same words are one node; two nodes link if their sets of ``words_each``-word shingles have a Jaccard
    similarity of at least ``least``, computed on the texts. Links are looked for among fingerprints of at most
    ``bits`` differing bits and in min-hash bands. A null key comes after all others; of rows equal in key and words
    one stays.
    """
    at = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    own = docs.select(at.alias("id"), common.text_of(text).alias("text"))
    every = common.durable(signed(own, words_each))
    nodes = common.durable(every.groupBy("mark").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    near = candidates(nodes.select(F.explode("bands").alias("band"), "first", "mark", "sketch"))
    heads = nodes.groupBy("fp").agg(F.min(F.struct("first", "mark")).alias("head")).select("fp", F.col("head.mark").alias("head"))
    heads = common.durable(heads)
    same = nodes.select("fp", "mark").join(heads, "fp").select(F.col("head").alias("a"), F.col("mark").alias("b"))
    by_fp = links(heads.select("fp"), bits).distinct()
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("one")), heads.select(F.col("fp").alias("b"), F.col("head").alias("other"))
    wide = by_fp.join(left, "a").join(right, "b").select(F.col("one").alias("a"), F.col("other").alias("b"))
    pairs = common.durable(near.union(same).union(wide).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    needed = common.durable(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct().join(nodes.select("mark", F.col("first").alias("id")), "mark"))
    wanted = needed.select("id").distinct()
    wanted = F.broadcast(wanted) if needed.count() <= BROADCAST_IDS else wanted
    found = own.join(wanted, "id", "left_semi").withColumn("mark", marked(F.col("text")))  # the texts are read again, not kept
    texts = common.durable(found.join(needed, ["mark", "id"], "left_semi").groupBy("mark").agg(F.first("text").alias("text")))

    @arrow_udf("boolean")
    def alike(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(ones, others):
            one, other = set(shingle_hashes(one.as_py(), words_each)), set(shingle_hashes(other.as_py(), words_each))
            both = len(one & other)
            out.append(both >= least * (len(one) + len(other) - both))
        return pa.array(out, pa.bool_())

    sides = pairs.join(texts.select(F.col("mark").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("mark").alias("b"), F.col("text").alias("other")), "b")
    linked = common.durable(sides.where(alike("one", "other")).select("a", "b"))
    for done in (texts, pairs, needed):
        forget(done)
    label = common.components(linked)
    forget(linked)
    named = nodes.select("mark", "first").join(label, nodes.mark == label.node, "left").select("first", "mark", F.coalesce("label", "mark").alias("label"))
    keep = common.durable(named.groupBy("label").agg(F.min(F.struct("first", "mark")).alias("one")).select("one.first", F.col("one.mark").alias("kept_mark")))
    if every.groupBy("id").count().where("count > 1").isEmpty():
        return docs.join(keep, at == keep["first"], "left_semi")

    mark = common.fresh(docs, "_mark")[0]
    told = docs.withColumn(mark, marked(common.text_of(text)))
    return told.join(keep, (at == keep["first"]) & (F.col(mark) == keep.kept_mark), "left_semi").dropDuplicates([key, mark]).drop(mark)
