"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are built or emitted."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common

#: Fixed value: the split pattern that byte-level BPE of this kind applies before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts remembered by a Python worker, of words up to LONGEST letters; beyond that it forgets all and begins anew.
REMEMBERED, LONGEST = 500_000, 256
SHIFT = 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeCounter(dict):
    """word -> number of tokens, computed when first asked for."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["ignore_merges"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        number = {letter: b for b, letter in enumerate(byte_letters())}
        #: pair of symbols -> rank and the symbol it becomes, packed
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = number.setdefault(left + right, len(number))
            self.ranks[number[left] << SHIFT | number[right]] = rank << SHIFT | new
        self.words = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode("utf-8"))
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        """Symbols left of ``word`` when the lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
        n = len(word)
        if n < 2:
            return n
        ranks, symbols, merges = self.ranks, list(word), 0
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got, i) for i in range(n - 1) if (got := ranks.get(symbols[i] << SHIFT | symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            got, i = heappop(heap)
            j = right[i]
            if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << SHIFT | symbols[j]) != got:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbols[i], symbols[j] = got & (1 << SHIFT) - 1, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (new := ranks.get(symbols[i] << SHIFT | symbols[k])) is not None:
                    heappush(heap, (new, i))
            if (h := left[i]) >= 0 and (new := ranks.get(symbols[h] << SHIFT | symbols[i])) is not None:
                heappush(heap, (new, h))
        return n - merges

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(part))) for part in parts)


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of the whole ``text`` as a long column ``name`` (a clash appends underscores).

    ``tokenizer`` is the path of a byte-level BPE .json file that every executor can read. Null and empty texts
    count 0; special strings of the file count 1 each; rows, repeated ones included, and other columns stay.
    """
    common.bounded_batches(docs.sparkSession)

    @arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        counts = counter(tokenizer)
        out = []
        for value in texts:
            if len(counts) > REMEMBERED:
                counts.clear()
            out.append(counts.count(value.as_py()))
        return pa.array(out, pa.int64())

    return docs.withColumn(common.fresh(docs, name)[0], tokens(common.text_of(text)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens of ``byte_bpe_50k.json``, and whether they are over 1024; see count_tokens."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.octet_length(common.text_of("text")).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
