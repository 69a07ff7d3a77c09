"""BPE encoding and decoding with content-defined chunks that documents share: each shared chunk is encoded once."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import bloom, common
from readloom.llm.token_counts import byte_letters

#: A chunk ends where the rolling hash of the last WINDOW characters has MASK_BITS zero bits, MIN characters or more on.
WINDOW_DOUBLINGS = 4
MASK_BITS = 10
MIN, MAX = 256, 1 << 14
#: Words, up to LONGEST letters, and digests that a Python worker remembers; beyond that it forgets all and begins anew.
REMEMBERED, LONGEST = 400_000, 256
SPACE = regex.compile(r"\s")
PART = "t1 bigint, t2 bigint, seq int, head string, ids binary, tail string, whole boolean, n bigint, ids_sha256 string, decoded_sha256 string"


def cuts(text: str) -> list[int]:
    """Ends of the chunks of ``text``; they depend on the characters near them only, so moved passages are cut alike."""
    n = len(text)
    if n <= MIN:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
    h = h ^ h >> np.uint32(15)
    for k in range(WINDOW_DOUBLINGS):  # h[i] covers 2^k characters; then twice as many
        step = 1 << k
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MAX:
            last += MAX
            ends.append(last)
        if mark - last >= MIN or mark == n and mark > last:
            ends.append(mark)
            last = mark
    return ends


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[s:e] for s, e in zip([0, *ends], ends)]


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


class WordCoder(dict):
    """word -> its ids as bytes (little-endian, 32 bits each), looked up in or computed by the vocabulary's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or spec["decoder"]:
            raise ValueError(f"{path} is no word-end BPE file of the known form")
        self.words = regex.compile(splits[0]).findall
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(SPACE.search(s) for s in self.special):  # joins are encoded anew between white space
            raise ValueError(f"{path} has special strings with white space")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, word: str) -> bytes:
        spelled = "".join([self.letters[b] for b in word.encode("utf-8")])
        ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.parts(text)):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
                out += map(self.__getitem__, self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def result(self, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8")).hexdigest()


@lru_cache(1)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def opened(text: str) -> tuple[str, str, str, bool]:
    """Head, middle and tail of a stretch: what stands before its first and after its last white space may join with
    its neighbours, the middle can't. A stretch without white space is whole: all of it is head."""
    first = SPACE.search(text)
    if not first:
        return text, "", "", True
    last = len(text) - SPACE.search(text[::-1]).start()
    return text[: first.start()], text[first.start() : last], text[last:], False


def short(ids: bytes) -> bytes:
    """Ids in 16 bits each where they fit, after a mark."""
    wide = np.frombuffer(ids, "<u4")
    return b"2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"4" + ids


def wide(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"2" else data[1:]


def halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def joined(parts: Iterator[tuple[str, bytes, str, bool]], encode) -> bytes:
    """Ids of a text from its stretches (head, ids of the middle, tail, whole).

    Around each join the run up to the nearest white space on either side is encoded anew; there both neighbours
    agree with the whole, as no token, normalisation or special string reaches across white space. A stretch without
    white space hands its run on to the next join.
    """
    out, run = [], ""
    for head, middle, tail, whole in parts:
        run += head
        if not whole:
            out += [encode(run), middle]
            run = tail
    out.append(encode(run))
    return b"".join(out)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "bpe") -> DataFrame:
    """``docs`` with a struct ``name``: n_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256 (their decoding).

    ``tokenizer`` is the path of a word-end BPE .json file that every executor can read. Chunks that come again, in
    other texts or in the same, are found by a twice-seen filter, encoded once in a task of their own, and joined to
    the texts that hold them; other stretches are encoded where they are read. Texts that have no shared chunk are
    done there and then. Equal texts are encoded once per task and joined by digest. Null and empty texts have no
    tokens; all rows, repeated ones included, and other columns stay.
    """
    common.bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(common.text_of(text).alias("text"))
    shared = context.broadcast(bloom.twice_seen(texts, F.col("text"), lambda value: map(digest, chunks(value)), 1 + F.char_length(F.col("text")) / MIN))

    def fresh_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[str], list[bytes], np.ndarray]]]:
        """Per batch (digest, chunks, their digests, which are suspected) of the texts that are new to this task."""
        seen: set[bytes] = set()
        for batch in batches:
            out, keys = [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for value in batch.column(0):
                value = value.as_py()
                if (own := digest(value)) in seen:
                    continue
                seen.add(own)
                pieces = chunks(value)
                marks = [digest(c) for c in pieces]
                out.append((own, pieces, marks, len(keys)))
                keys += marks
            hit = shared.value.suspects(keys) if keys else np.zeros(0, bool)
            yield [(own, pieces, marks, hit[at : at + len(marks)]) for own, pieces, marks, at in out]

    def shared_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for new in fresh_texts(batches):
            if len(given) > REMEMBERED:
                given.clear()
            rows = {m: c for _, pieces, marks, hit in new for c, m, h in zip(pieces, marks, hit) if h and m not in given}
            given.update(rows)
            yield pa.record_batch([*halves([*rows]), pa.array([*rows.values()], pa.string())], names=["d1", "d2", "chunk"])

    def encoded_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = coder(tokenizer), None
        for batch in batches:
            if len(code) > REMEMBERED:
                code.clear()
            rows = []
            for d1, d2, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (d1, d2) == last:
                    continue
                last = (d1, d2)
                head, middle, tail, whole = opened(chunk.as_py())
                rows.append((d1, d2, head, short(code.encode(middle)), tail, whole))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["e1", "e2", "head", "ids", "tail", "whole"])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in fresh_texts(batches):
            rows = [(own, i, m) for own, _, marks, hit in new for i, (m, h) in enumerate(zip(marks, hit)) if h]
            yield pa.record_batch([*halves([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), *halves([r[2] for r in rows])], names=["t1", "t2", "seq", "d1", "d2"])

    def own_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for new in fresh_texts(batches):
            if len(code) > REMEMBERED:
                code.clear()
            keys, rows = [], []
            for own, pieces, _, hit in new:
                if not hit.any():
                    keys.append(own)
                    rows.append((0, None, None, None, None, *code.result(code.encode("".join(pieces)))))
                    continue
                i = 0
                while i < len(pieces):
                    if hit[i]:
                        i += 1
                        continue
                    j = i
                    while j < len(pieces) and not hit[j]:
                        j += 1
                    head, middle, tail, whole = opened("".join(pieces[i:j]))
                    keys.append(own)
                    rows.append((i, head, short(code.encode(middle)), tail, whole, None, None, None))
                    i = j
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string())
            names = ["t1", "t2", "seq", "head", "ids", "tail", "whole", "n", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch([*halves(keys), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over the parts of texts in order; parts that several tasks gave count once."""
        code, now, parts, out = coder(tokenizer), None, [], []

        def finish() -> None:
            if now is not None:
                done = next((p[5:] for p in parts if p[5] is not None), None)
                result = done or code.result(joined(((p[1], wide(p[2]), p[3], p[4]) for p in parts), code.encode))
                out.append((*now, *result))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            rows = pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["t1", "t2", "n", "ids_sha256", "decoded_sha256"])
            out.clear()
            return rows

        for batch in batches:
            if len(code) > REMEMBERED:
                code.clear()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != now:
                    finish()
                    now, parts = row[:2], []
                if not parts or parts[-1][0] != row[2]:
                    parts.append(row[2:])
            yield flush()
        finish()
        yield flush()

    suspected = texts.mapInArrow(shared_chunks, "d1 bigint, d2 bigint, chunk string")
    encoded = suspected.repartition("d1", "d2").sortWithinPartitions("d1", "d2").mapInArrow(encoded_once, "e1 bigint, e2 bigint, head string, ids binary, tail string, whole boolean")
    held = texts.mapInArrow(references, "t1 bigint, t2 bigint, seq int, d1 bigint, d2 bigint").join(encoded, F.expr("d1 = e1 and d2 = e2"))
    held = held.select("t1", "t2", "seq", "head", "ids", "tail", "whole", *(F.lit(None).cast(k).alias(c) for c, k in (("n", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))))
    parts = texts.mapInArrow(own_stretches, PART).unionByName(held)
    results = parts.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "seq").mapInArrow(assembled, "t1 bigint, t2 bigint, n bigint, ids_sha256 string, decoded_sha256 string")

    @arrow_udf("struct<t1:bigint,t2:bigint>")
    def text_digest(values: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([*halves([digest(v.as_py()) for v in values])], ["t1", "t2"])

    mark, r1, r2, out = common.fresh(docs, "_mark", "_r1", "_r2", name)
    results = results.select(F.col("t1").alias(r1), F.col("t2").alias(r2), F.struct(F.col("n").alias("n_tokens"), "ids_sha256", "decoded_sha256").alias(out))
    marked = docs.withColumn(mark, text_digest(common.text_of(text)))
    return marked.join(results, (F.col(f"{mark}.t1") == F.col(r1)) & (F.col(f"{mark}.t2") == F.col(r2))).drop(mark, r1, r2)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens of ``word_bpe_49k.json``, and the digests of the ids and of the text decoded from them; see encode_documents."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "bpe.*")
