"""Near duplicates by SimHash: deletion-variant signatures, equality join, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Shingles whose bits are summed at once.
BLOCK = 1 << 17
#: Fingerprints of one signature that are compared all with all; larger signatures are probed bit by bit instead.
COMPARED = 1 << 15
#: Fingerprints of one signature that one task takes; signatures with more are split by the bits outside their segment.
SPLIT = 1 << 18


def shingle_hashes(text: str, words_each: int) -> list[int]:
    words = text.encode("utf-8").lower().split()  # bytes: lower() takes A-Z only, split() only \x20 and \x09-\x0D
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return [digest(b" ".join(words), 42)]
    runs = zip(*(words[i:] if i else words for i in range(words_each)))
    return [digest(run, 42) for run in map(b" ".join, runs)]


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """Fingerprint of each run of ``counts[i]`` hashes: a bit is 1 if set in over half of the run; 0 for an empty run."""
    out, n = np.zeros(len(counts), "<u8"), np.array(counts, "i8")
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
    ones = np.add.reduceat(bits, starts, axis=0, dtype="i8")
    out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", words_each: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit SimHash of the whole text as a (signed) long column ``name``.

    Words are the runs free of \\x20 and \\x09-\\x0D after lower-casing A-Z; shingles of ``words_each`` words, repeats
    included, are hashed by XXH64 with seed 42. Fewer words are one shingle; null and empty texts give 0.
    """
    common.bounded_batches(docs.sparkSession)

    @arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        done, hashes, counts = [], [], []
        for value in texts:
            new = shingle_hashes(value.as_py(), words_each)
            hashes += new
            counts.append(len(new))
            if len(hashes) >= BLOCK:
                done.append(majority(hashes, counts))
                hashes, counts = [], []
        done.append(majority(hashes, counts))
        return pa.array(np.concatenate(done).view("i8"), pa.int64())

    return docs.withColumn(name, simhash(common.text_of(text)))


def nearest_roots(values: np.ndarray, bits: int) -> np.ndarray:
    """For sorted distinct ``values``: the number of the smallest value that links of at most ``bits`` bits lead to."""
    root = np.arange(len(values))
    if len(values) <= COMPARED:
        step = max(1, (1 << 22) // len(values))
        pairs = []
        for s in range(0, len(values), step):
            i, j = np.nonzero(np.bitwise_count(values[s : s + step, None] ^ values[None, :]) <= bits)
            pairs.append((i + s, j))
            if len(pairs) > 1 and sum(len(p[0]) for p in pairs) > 1 << 22:
                root = settled(root, pairs)
                pairs = []
        return settled(root, pairs)
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    singles = [1 << b for b in range(64) if free >> b & 1]
    masks = [0]
    for _ in range(bits):
        masks = sorted({m ^ s for m in masks for s in singles} | set(masks))
    while True:
        before = root.copy()
        for mask in masks[1:]:
            other = values ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.flatnonzero(values[at] == other)
            np.minimum.at(root, root[hit], root[at[hit]])
            root[hit] = np.minimum(root[hit], root[at[hit]])
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def settled(root: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``root`` after joining the pairs, as the smallest number of each group; groups already made stay joined."""
    i = np.concatenate([p[0] for p in pairs] + [np.arange(len(root))])
    j = np.concatenate([p[1] for p in pairs] + [root])
    root = np.arange(len(root))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not (new == new[new]).all():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def verified_links(bits: int):
    """Over rows (signature, fp) sorted by signature: links that join what each signature's fingerprints join.

    A signature with m fingerprints gives at most m - 1 links, each to the smallest of its group; pairs that differ
    in more than ``bits`` bits are never linked, and nothing that such pairs would connect is lost.
    """

    def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        edge = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
        size = ends - starts
        two = starts[size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
        a.append(fps[near])
        b.append(fps[near + 1])
        for s, e in zip(starts[size > 2], ends[size > 2]):
            values = np.unique(fps[s:e])
            root = nearest_roots(values, bits)
            to = np.flatnonzero(root != np.arange(len(values)))
            a.append(values[root[to]])
            b.append(values[to])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys: list[np.ndarray] = []  # rows of one signature, which the next batch may go on with
        open_fps: list[np.ndarray] = []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("u8")
            if not len(keys):
                continue
            if open_keys and open_keys[0][0] != keys[-1] or keys[0] != keys[-1]:
                last = int(np.searchsorted(keys, keys[-1]))
                yield rows(*linked(np.concatenate([*open_keys, keys[:last]]), np.concatenate([*open_fps, fps[:last]])))
                open_keys, open_fps, keys, fps = [], [], keys[last:], fps[last:]
            open_keys.append(keys)
            open_fps.append(fps)
        if open_keys:
            yield rows(*linked(np.concatenate(open_keys), np.concatenate(open_fps)))

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])

    return run


def cut(positions: list[int], pieces: int) -> list[list[int]]:
    n = len(positions)
    return [positions[n * i // pieces : n * (i + 1) // pieces] for i in range(pieces)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that differ in at most ``bits`` bits.

    The 64 bits are cut into (bits + 1) / 2 segments, rounded up, so that of any such pair one segment differs in at
    most one bit. Each fingerprint is indexed under every segment with every single bit as a wildcard; equal
    signatures meet in one partition and are verified there on all 64 bits. A signature that more than SPLIT
    fingerprints may share is split in the same way by the bits outside its segment, so no task grows with it.
    """
    pieces = (bits + 2) // 2
    segments = [(s[0], s[-1] + 1) for s in cut([*range(64)], pieces)]
    if max(high - low for low, high in segments) > 57:
        raise ValueError("at least 2 bits, so that a signature fits a long")
    own = lambda low, high: f"(shiftrightunsigned(fp, {low}) & {(1 << high - low) - 1}L)"
    variants = ", ".join(f"struct({s} as segment, shiftleft({b}L, 57) + ({own(low, high)} & {~(1 << b - low)}L) as signature)" for s, (low, high) in enumerate(segments) for b in range(low, high))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(parts, F.xxhash64("fp", F.lit(1)))  # few bytes, but each row becomes 64: not to be left to a task or two
    keyed = spread.select("fp", F.expr(f"inline(array({variants}))"))
    values = ", ".join(f"struct({s} as segment, {own(low, high)} as value)" for s, (low, high) in enumerate(segments))
    hot = common.durable(distinct.select(F.expr(f"inline(array({values}))")).groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT // 2))
    if not hot.isEmpty():  # a signature joins two values of its segment
        low, high = (F.element_at(F.array(*(F.lit(s[i]) for s in segments)), F.col("segment") + 1) for i in (0, 1))
        wild = hot.select("value", low.alias("low"), F.explode(F.sequence(low, high - 1)).alias("b"))
        wild = wild.select(F.expr("shiftleft(cast(b as bigint), 57) + (value & ~shiftleft(1L, b - low))").alias("split")).distinct()
        outside = [[p for p in range(64) if not low <= p < high] for low, high in segments]
        finer = [", ".join(f"xxhash64(signature, {b}, fp & {signed(sum(1 << p for p in piece) & ~(1 << b))}L)" for piece in cut(rest, pieces) for b in piece) for rest in outside]
        every = F.expr("case " + " ".join(f"when split is not null and segment = {s} then array({f})" for s, f in enumerate(finer)) + " else array(signature) end")
        keyed = keyed.join(wild, keyed.signature == wild.split, "left").select("fp", F.explode(every).alias("signature"))
    dealt = keyed.select("signature", "fp").repartition("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(verified_links(bits), "a bigint, b bigint")


def labelled(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, first, label) per distinct fingerprint of ``prints`` (id, fp): its smallest id and its component."""
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    label = common.components(links(least.select("fp"), bits))
    return least.join(label, least.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3, bits: int = 3, drop_text: bool = False) -> DataFrame:
    """``docs`` with fp (signed long) and component_id; a clash of names appends underscores.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest ``key`` reachable, the row's
    own included. Rows with a null key take part but never name a component (it is null if all its keys are null).
    Copies share a fingerprint and are compared once, so a group of copies costs one row however large it is. All rows
    and columns stay; ``drop_text`` leaves the text behind, so that it isn't written and shuffled.
    """
    own, component, named = common.fresh(docs, "fp", "component_id", "_named")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    prints = fingerprints(docs, text, words_each, own)
    prints = common.durable(prints.select(*rest, own) if drop_text else prints)
    grouped = labelled(prints.select(F.col(key).alias("id"), F.col(own).alias("fp")), bits)
    smallest = grouped.groupBy("label").agg(F.min("first").alias("least"))
    names = grouped.join(smallest, "label").select(F.col("fp").alias(named), F.col("least").alias(component))
    return prints.join(names, F.col(own) == F.col(named)).drop(named)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the smallest ``key``, with all its columns.

    A null key comes after all others. Where rows repeat a key, their fingerprints tell them apart, then the smallest
    hash of their texts, and of rows equal in all that one stays.
    """
    at, mark = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(common.text_of(text))
    prints = fingerprints(docs.select(at.alias("id"), F.col(text).alias("text")), "text", words_each)
    prints = common.durable(prints.select("id", "fp", F.xxhash64(common.text_of("text")).alias("mark")))
    keep = common.durable(labelled(prints, bits).groupBy("label").agg(F.min(F.struct("first", "fp")).alias("one")).select("one.first", F.col("one.fp").alias("kept_fp")))
    if prints.groupBy("id").count().where("count > 1").isEmpty():
        return docs.join(keep, at == keep["first"], "left_semi")
    keep = prints.join(keep, (prints.id == keep["first"]) & (prints.fp == keep.kept_fp)).groupBy("first", "kept_fp").agg(F.min("mark").alias("kept_mark"))
    own = common.fresh(docs, "_mark")[0]
    marked = docs.withColumn(own, mark)
    return marked.join(keep, (at == keep["first"]) & (F.col(own) == keep.kept_mark), "left_semi").dropDuplicates([key, own]).drop(own)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its fingerprint in hex, and the smallest doc_id that links of 3 bits or fewer reach; see near_duplicates."""
    out = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
