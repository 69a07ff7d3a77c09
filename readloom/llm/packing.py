"""Packing of tokenized documents into sequences: best fit first, then swap-based local search."""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from readloom.llm import common
from readloom.llm.token_counts import PATTERN, byte_letters

#: Pieces that are packed together, on average: one task's share, whatever the size of the corpus.
GROUP_PIECES = 4096
PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class Encoder:
    """Ids of a byte-level BPE .json file, by a merge engine that is several times as fast on whole texts."""

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        number = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(number[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special="all")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of each document: the columns of ``docs`` but the text, piece, start, length, ids_crc32 (a clash
    of names appends underscores to the document's own column).

    A document is its ids and the id ``end``; only one longer than ``capacity`` is cut, and then its first piece
    takes what is over, so that all the others are full. Null and empty texts are the end id alone.
    """
    common.bounded_batches(docs.sparkSession)

    @arrow_udf(PIECE)
    def cut(texts: pa.Array) -> pa.Array:
        encode, offsets, rows = encoder(tokenizer).ids, [0], []
        tail = np.array([end], dtype="<u4")
        for value in texts:
            ids = np.concatenate([encode(value.as_py()).astype("<u4", copy=False), tail])
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            data = ids.tobytes()
            rows += [(i, s, e - s, crc32(data[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
            offsets.append(len(rows))
        piece, start, length, crc = (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))) if rows else (pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([piece, start, length, crc], ["piece", "start", "length", "ids_crc32"]))

    made = {"piece", "start", "length", "ids_crc32"}
    rest = [c for c in docs.columns if c != text or c == key]
    shown = {c: common.fresh(docs, f"{c}_")[0] if c.lower() in made else c for c in rest}
    whole = common.fresh(docs, "_pieces")[0]
    cuts = docs.select(*(F.col(f"`{c}`") for c in rest), cut(common.text_of(text)).alias(whole))
    return cuts.select(*(F.col(f"`{c}`").alias(n) for c, n in shown.items()), F.inline(whole))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some bin has r left
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > size:
            by_room.setdefault(room - size, []).append(b)
            rooms |= 1 << (room - size)
    return bins


def exchange(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search between underfull bins: moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The emptiest bin gives and the fuller ones take, until it is empty; each step makes a fuller bin fuller still, so
    the sum of squares rises and the search ends: at the fewest bins there can be, or when a pass in which every
    underfull bin has given what it can changes nothing.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    fewest = -(-sum(fill) // capacity)
    count = sum(1 for b in bins if b)
    held: dict[int, list[tuple[int, int]]] = {b: sorted((lengths[i], i) for i in bins[b]) for b in range(len(bins)) if fill[b] < capacity}
    changed = True
    while changed and count > fewest:
        changed = False
        for d in sorted((b for b in held if held[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            if count <= fewest:
                break
            moved = True
            while moved and held[d]:
                moved = False
                for r in sorted((b for b in held if b != d and held[b] and fill[b] < capacity and fill[b] >= fill[d]), key=lambda b: (-fill[b], b)):
                    while held[d] and fill[r] < capacity and (step := best_step(held[r], held[d], capacity - fill[r])):
                        gone, got = step
                        gain = sum(x[0] for x in got) - sum(x[0] for x in gone)
                        if fill[r] + gain <= fill[d]:
                            break
                        for x in gone:
                            held[r].remove(x)
                            insort(held[d], x)
                        for x in got:
                            held[d].remove(x)
                            insort(held[r], x)
                        fill[r] += gain
                        fill[d] -= gain
                        moved = changed = True
                    if not held[d]:
                        break
            count -= not held[d]
    for b, items in held.items():
        bins[b] = [i for _, i in items]
    return [b for b in bins if b]


def best_step(taker: list[tuple[int, int]], giver: list[tuple[int, int]], room: int) -> tuple[list, list] | None:
    """What leaves the taker and what it gets, for the largest gain of at most ``room``; none if nothing gains."""
    best, gain = None, 0
    at = bisect_right(giver, (room, 1 << 62)) - 1
    if at >= 0:
        best, gain = ([], [giver[at]]), giver[at][0]
    previous = -1
    for x in taker:
        if gain == room:
            break
        if x[0] == previous:
            continue
        previous = x[0]
        at = bisect_right(giver, (x[0] + room, 1 << 62)) - 1
        if at >= 0 and giver[at][0] - x[0] > gain:
            best, gain = ([x], [giver[at]]), giver[at][0] - x[0]
        low, high, limit = 0, len(giver) - 1, x[0] + room
        while low < high:
            both = giver[low][0] + giver[high][0]
            if both > limit:
                high -= 1
            else:
                if both - x[0] > gain:
                    best, gain = ([x], [giver[low], giver[high]]), both - x[0]
                low += 1
    return best


def pack(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset (a clash of names appends underscores): no sequence is over ``capacity`` and
    offsets leave no gaps.

    Full pieces are sequences by themselves. The others are dealt evenly into groups of GROUP_PIECES on average, whatever
    repeats among them, and each group is packed by one task: the number of groups follows the input. Rows that repeat
    are packed each; all columns stay. ``length`` must be 1 or more, and of a length over ``capacity`` the row is a
    sequence by itself.
    """
    pieces = common.durable(pieces)
    sequence_id, offset, group_of = common.fresh(pieces, "sequence_id", "offset", "_group")
    number = F.monotonically_increasing_id()  # of checkpointed rows, so a task that is run again deals them alike
    full = pieces.withColumn(sequence_id, -1 - number).where(F.col("length") >= capacity).withColumn(offset, F.lit(0).cast("long"))
    rest = pieces.withColumn(group_of, number).where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    names = pieces.columns

    def packed(data: pa.Table) -> pa.Table:
        group = data.column(group_of)[0].as_py()
        data = data.drop_columns([group_of]).sort_by([("length", "descending"), *((k, "ascending") for k in keys)])
        lengths = data.column("length").to_pylist()
        sequence, place = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
        for b, items in enumerate(exchange(lengths, best_fit(lengths, capacity), capacity)):
            at = 0
            for i in items:
                sequence[i], place[i] = group << 32 | b, at
                at += lengths[i]
        return data.append_column(sequence_id, pa.array(sequence)).append_column(offset, pa.array(place))

    dealt = rest.withColumn(group_of, F.pmod(F.xxhash64(group_of, F.lit(8)), F.lit(groups)))
    kind = StructType([*pieces.schema.fields, StructField(sequence_id, LongType()), StructField(offset, LongType())])
    fitted = dealt.groupBy(group_of).applyInArrow(packed, kind)
    return full.select(*(F.col(f"`{c}`") for c in names), sequence_id, offset).unionByName(fitted)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; see token_pieces and pack."""
    import public_tokenizers

    pieces = token_pieces(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces)
