"""Alignment of two tokenizers over the same text: a dangling-suffix transducer, link counts of id pairs over the corpus."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from readloom.llm import common, packing

#: A text is cut into stretches where a space or line feed follows something that is no white space. Neither tokenizer has
#: a token across such a place (checked when they are loaded), so stretches are encoded and aligned once and used again.
STRETCH = re.compile(r"\s*+\S++(?:(?![ \n])\s++(?:\S++|\Z))*+|\s++")
#: Texts of so many bytes are put together in one block, a row of the table that both passes share.
BLOCK_BYTES = 4 << 20
#: Letters of stretches that a Python worker remembers: of so many, those not met again while half as many were new are
#: forgotten. Longer stretches are not remembered.
REMEMBERED, LONGEST = 6 << 20, 256
LONG_TEXT = 1 << 20
#: Transitions that a worker remembers for either side.
STEPS = 1 << 20
#: Stretches that are encoded, or joined for a text's digest, at a time.
AT_ONCE = 1 << 13
SHIFT = 32
BLOCK = "block bigint, keys {}, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, stretches binary, ends binary, links binary, link_ends binary, pairs array<bigint>, times array<bigint>"
GROUPS = "array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>"


class Aligned(NamedTuple):
    """A stretch: its numbers of A tokens, B tokens and groups, the groups as text, and its linked pairs (A id << 32 | B id) as int64."""

    n_a: int
    n_b: int
    n_groups: int
    shown: str
    links: bytes


class Aligner:
    """Both tokenizers, and the transducer between their token bytes.

    ``tokenizer_a`` is a byte-level BPE .json file, ``model_b`` a sentencepiece BPE model that puts a space in front.
    """

    def __init__(self, tokenizer_a: str, model_b: str) -> None:
        import sentencepiece

        self.encode_a = packing.encoder(tokenizer_a).engine.encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_b)
        bytes_of = packing.encoder(tokenizer_a).engine.decode_single_token_bytes
        self.bytes_a = Lazy(bytes_of)
        self.bytes_b = [self.piece_bytes(i) for i in range(self.model.get_piece_size())]
        shown = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in shown):
            raise ValueError(f"{model_b} has pieces across white space")
        if self.model.normalize(" a  \t\u00a0\ufb01 ") != "▁▁a▁▁\t\u00a0\ufb01▁" or self.model.piece_to_id("▁") == self.model.unk_id():
            raise ValueError(f"{model_b} changes texts before it cuts them")
        #: per side that lags: (unmatched bytes of the other side, next token) -> unmatched bytes after it, whether it then leads
        self.steps: tuple[dict, dict] = ({}, {})

    def piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def step(self, side: int, dangling: bytes, token: int) -> tuple[bytes, bool] | None:
        """What dangles after ``token`` of the lagging ``side`` (0 is A), and whether that is ``token``'s own end; none if the bytes differ."""
        memo = self.steps[side]
        found = memo.get((dangling, token), 0)
        if found == 0:
            own = (self.bytes_b if side else self.bytes_a)[token]
            if len(own) <= len(dangling):
                found = (dangling[len(own) :], False) if dangling.startswith(own) else None
            else:
                found = (own[len(dangling) :], True) if own.startswith(dangling) else None
            if len(memo) >= STEPS:
                memo.clear()
            memo[dangling, token] = found
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """(ends, links): how many A and B tokens each group ends at, and the linked pairs; none if the bytes differ.

        The side that leads has one token reaching past all of the other side; the next token of the lagging side
        overlaps that one and no other. When nothing dangles, a group is closed.
        """
        ends, links, i, j, n, m, dangling, a_leads = [], [], 0, 0, len(a), len(b), b"", True
        lag_a, lag_b = self.steps
        while True:
            if not dangling:
                if i:
                    ends.append((i, j))
                if i == n or j == m:
                    return (ends, links) if i == n and j == m else None
                own_a, a_leads = a[i], True
                dangling = self.bytes_a[own_a]
                i += 1
            if a_leads:
                if j == m:
                    return None
                own_b = b[j]
                j += 1
                found = lag_b.get((dangling, own_b), 0) or self.step(1, dangling, own_b)
            else:
                if i == n:
                    return None
                own_a = a[i]
                i += 1
                found = lag_a.get((dangling, own_a), 0) or self.step(0, dangling, own_a)
            if found is None:
                return None
            links.append(own_a << SHIFT | own_b)
            dangling, flips = found
            if flips:
                a_leads = not a_leads

    def tokens(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of both sides for each stretch. A dummy space goes in front of what B gets: it is the stretch's own or is taken away."""
        spaced = [s.startswith(" ") for s in stretches]
        every = self.model.encode([s[1:] if own else s for s, own in zip(stretches, spaced)], num_threads=1)
        for s, own, b in zip(stretches, spaced, every):
            if s == " ":  # the model gives an empty text no tokens
                b = [self.model.piece_to_id("▁")]
            yield self.encode_a(s), b if own else b[1:]

    def aligned(self, stretches: list[str]) -> Iterator[Aligned | None]:
        for a, b in self.tokens(stretches):
            found = self.groups(a, b)
            if found is None:
                yield None
                continue
            ends, links = found
            names_a, names_b, parts, i, j = [*map(str, a)], [*map(str, b)], [], 0, 0
            for k, m in ends:
                parts.append(",".join(names_a[i:k]) + "|" + ",".join(names_b[j:m]))
                i, j = k, m
            yield Aligned(len(a), len(b), len(ends), ";".join(parts), array("q", links).tobytes())


class Lazy(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: int) -> bytes:
        out = self[key] = self.make(key)
        return out


class Numbers(dict):
    """stretch -> its number in a block, given when it is first met."""

    def __missing__(self, stretch: str) -> int:
        out = self[stretch] = len(self)
        return out


class Remembered:
    """Alignments of stretches that a worker has met, bounded by their letters: what was met lately, and what was before."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.known, self.before, self.letters = aligner, {}, {}, 0

    def of(self, stretches: Iterable[str]) -> list[Aligned | None]:
        stretches = list(stretches)
        if self.letters > REMEMBERED // 2:
            self.known, self.before, self.letters = {}, self.known, 0
        found = {s: self.before[s] for s in stretches if s not in self.known and s in self.before}
        new = [s for s in stretches if s not in self.known and s not in found]
        for at in range(0, len(new), AT_ONCE):
            found.update(zip(new[at : at + AT_ONCE], self.aligner.aligned(new[at : at + AT_ONCE])))
        out = [found[s] if s in found else self.known[s] for s in stretches]
        short = {s: x for s, x in found.items() if len(s) <= LONGEST}
        self.known |= short
        self.letters += sum(map(len, short))
        return out


@lru_cache(1)
def remembered(tokenizer_a: str, model_b: str) -> Remembered:
    return Remembered(Aligner(tokenizer_a, model_b))


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


class Block:
    """Texts that are aligned together: each text as numbers of the block's stretches, each stretch as numbers of its pairs."""

    def __init__(self) -> None:
        self.keys: list = []
        self.texts: list[np.ndarray] = []
        self.numbers = Numbers()
        self.size = 0

    def add(self, key: object, text: str) -> None:
        self.keys.append(key)
        if len(text) < LONG_TEXT:
            found = STRETCH.findall(f" {text}") if text else ()
        else:  # a long text's stretches are not held all at once
            found = (m.group() for m in STRETCH.finditer(f" {text}"))
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, found), "i4"))
        self.size += len(text)

    def row(self, number: int, known: Remembered, key_type: pa.DataType) -> pa.RecordBatch:
        every = known.of(self.numbers)
        good = np.array([x is not None for x in every], bool)
        texts = [t if good[t].all() else t[:0] for t in self.texts]
        sums = lambda name: np.array([0 if x is None else getattr(x, name) for x in every], "i8")
        totals = {name: [int(own[t].sum()) for t in texts] for name in ("n_a", "n_b", "n_groups") for own in [sums(name)]}
        shown = [x and x.shown for x in every]
        links = [b"" if x is None else x.links for x in every]
        pairs, at = np.unique(np.frombuffer(b"".join(links), "i8"), return_inverse=True)
        met = np.concatenate([*texts, np.empty(0, "i4")])
        often = np.bincount(met, minlength=len(every)).astype("i8")
        lengths = np.array([len(x) // 8 for x in links], "i8")
        times = np.zeros(len(pairs), "i8")
        np.add.at(times, at, np.repeat(often, lengths))
        list_of = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = {
            "block": pa.array([number], pa.int64()), "keys": list_of(self.keys, key_type),
            **{name: list_of(values, pa.int64()) for name, values in totals.items()},
            "groups_sha256": list_of([digest(t, shown) for t in texts], pa.string()),
            "stretches": pa.array([packed(met)], pa.binary()), "ends": pa.array([packed(np.cumsum([len(t) for t in texts]))], pa.binary()),
            "links": pa.array([packed(at)], pa.binary()), "link_ends": pa.array([packed(np.cumsum(lengths))], pa.binary()),
            "pairs": list_of(pairs, pa.int64()), "times": list_of(times, pa.int64()),
        }
        return pa.record_batch(list(columns.values()), names=list(columns))


def digest(stretches: np.ndarray, shown: list[str]) -> str:
    if not len(stretches):
        return ""
    out, every = hashlib.sha256(), iter(stretches.tolist())
    parts = islice(every, AT_ONCE)
    joint = ""
    while now := [shown[i] for i in parts]:
        out.update((joint + ";".join(now)).encode())
        joint, parts = ";", islice(every, AT_ONCE)
    return out.hexdigest()


def blocks(docs: DataFrame, tokenizer_a: str, model_b: str, key: str, text: str) -> DataFrame:
    """Rows of BLOCK: the aligned texts, with the pairs that each block links and how often."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(tokenizer_a, model_b)
        number, block = TaskContext.get().partitionId() << SHIFT, Block()
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(own, value.as_py())
                if block.size >= BLOCK_BYTES:
                    yield block.row(number, known, key_type)
                    number, block = number + 1, Block()
        if block.keys:
            yield block.row(number, known, key_type)

    return docs.select(F.col(f"`{key}`").alias("key"), common.text_of(text).alias("text")).mapInArrow(build, BLOCK.format(f"array<{kind}>"))


def counts_of(built: DataFrame) -> DataFrame:
    """(pair, links, best): how many links hold each pair, over all blocks, and whether no pair of its B id has more."""
    pairs = built.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("links")).withColumnRenamed("pairs", "pair")
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    return pairs.where("links > 0").select("pair", "links", (F.col("links") == F.max("links").over(of_b)).alias("best"))


def pair_counts(docs: DataFrame, tokenizer_a: str, model_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, links, best): every pair of ids that is linked anywhere, by how many links."""
    found = counts_of(blocks(docs, tokenizer_a, model_b, key, text))
    return found.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "links", "best")


def align_documents(docs: DataFrame, tokenizer_a: str, model_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    A is the byte-level BPE of space + text, B the sentencepiece model of the text; special strings are plain text. A
    link is a pair of tokens whose byte ranges overlap; groups end where tokens of both end. ``n_best`` counts links
    whose pair is linked as often, over all of ``docs``, as any pair of its B id; ``count_sum`` adds up those counts. Null
    and empty texts, and texts whose tokens don't give their bytes back (such as those holding U+2581), are zeros with
    an empty digest and add nothing to the counts. Rows that repeat a key stay rows of their own; other columns don't
    come along.

    The texts are read once. Each task turns its texts into blocks of numbers; only the pairs of a block, each once,
    are shuffled to the counts and back, so neither hot pairs nor long texts meet in one task.
    """
    built = common.durable(blocks(docs, tokenizer_a, model_b, key, text))
    asked = built.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts_of(built), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "links", "best"))).alias("told"))
    told = told.select("block", *(F.col(f"told.{c}").alias(f"told_{c}") for c in ("at", "links", "best")))
    kind = docs.schema[key].dataType.simpleString()
    shown = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield finished({name: batch.column(name)[i] for name in batch.schema.names})

    def finished(row: dict) -> pa.RecordBatch:
        pairs = len(row["pairs"].values)
        links, best = np.zeros(pairs, "i8"), np.zeros(pairs, "i8")
        if row["told_at"].is_valid:
            at = row["told_at"].values.to_numpy()
            links[at], best[at] = row["told_links"].values.to_numpy(), row["told_best"].values.to_numpy(zero_copy_only=False)
        ends, stretches, link_ends, linked = (unpacked(row[name].as_py()) for name in ("ends", "stretches", "link_ends", "links"))
        summed = lambda of_pairs: between(between(of_pairs[linked], link_ends)[stretches], ends)
        sizes = {name: row[name].values.to_numpy() for name in ("n_a", "n_b", "n_groups")}
        sizes |= {"n_links": sizes["n_a"] + sizes["n_b"] - sizes["n_groups"], "n_best": summed(best), "count_sum": summed(links)}
        return pa.record_batch([row["keys"].values, *(pa.array(sizes[n]) for n in shown), row["groups_sha256"].values], names=["key", *shown, "groups_sha256"])

    out = built.join(told, "block", "left").mapInArrow(finish, f"key {kind}, {', '.join(f'{n} bigint' for n in shown)}, groups_sha256 string")
    return out.withColumnRenamed("key", key)


def between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` up to each end from the end before it."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends]).astype("i8")])


def aligned_groups(docs: DataFrame, tokenizer_a: str, model_b: str, text: str = "text", name: str = "groups") -> DataFrame:
    """``docs`` with the groups of each text: A ids, B ids, and their bytes' start and end in the text with a space in front.

    Texts without tokens (see align_documents) have none. A clash of names appends underscores.
    """
    common.bounded_batches(docs.sparkSession)

    @arrow_udf(GROUPS)
    def groups(texts: pa.Array) -> pa.Array:
        aligner = remembered(tokenizer_a, model_b).aligner
        rows = []
        for value in texts:
            out, start = [], 0
            for a, b in aligner.tokens(STRETCH.findall(f" {value.as_py()}")) if value.as_py() else ():
                found = aligner.groups(a, b)
                if found is None:
                    out = []
                    break
                for (i, j), (k, m) in zip([(0, 0), *found[0]], found[0]):
                    end = start + sum(len(aligner.bytes_a[x]) for x in a[i:k])
                    out.append({"a": a[i:k], "b": b[j:m], "start": start, "end": end})
                    start = end
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())])))

    return docs.withColumn(common.fresh(docs, name)[0], groups(common.text_of(text)))


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of ``byte_bpe_50k.json`` and ``piece_bpe_32k.model`` over all documents; see align_documents."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
