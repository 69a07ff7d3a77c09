"""Token counts, BPE round trips and packing, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readloom.llm import bpe_reuse, packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "B ", " ", "\n", "\x1c", "\x0b", "\x85", "\xa0", "é", "é", "½", "١", "'s", "!", "<|endoftext|>", "<|startoftext|>", "😀", "​", "　", "ǅ", "Σ", "ΑΣ", "İ", "ß", "ᄀ", "ᅡ", "Ⅷ", "the", "  "]
KIND = "doc_id long, text string, n_tokens long, bpe string, _mark string"


def odd_texts(n=300, size=30, seed=2):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(size))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], KIND)


TEXTS = ["", None, "a", "same text here", "same text here", "x" * 20000, "word " * 4000, "<|endoftext|>", *odd_texts(60)]


def test_counts(spark):
    library = Tokenizer.from_file(BYTES)
    out = token_counts.count_tokens(table(spark, TEXTS), BYTES)
    assert out.columns == [*KIND.replace(" long", "").replace(" string", "").split(", "), "n_tokens_"]
    got = {r["doc_id"]: r["n_tokens_"] for r in out.collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert token_counts.count_tokens(table(spark, []), BYTES).count() == 0


def test_counts_of_odd_texts():
    library, own = Tokenizer.from_file(BYTES), token_counts.MergeCounter(BYTES)
    for t in odd_texts(2000):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_coder_and_joins():
    library, own = Tokenizer.from_file(WORDS), bpe_reuse.WordCoder(WORDS)
    draw = random.Random(3)
    for t in odd_texts(1500):
        want = library.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
        cuts = sorted(draw.sample(range(len(t) + 1), min(4, len(t))))
        parts = [bpe_reuse.opened(t[a:b]) for a, b in zip([0, *cuts], [*cuts, len(t)])]
        assert bpe_reuse.joined(((h, own.encode(m), z, w) for h, m, z, w in parts), own.encode) == ids


def test_chunks_are_content_defined():
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(9000))
    one, two = bpe_reuse.chunks("x" * 700 + passage), bpe_reuse.chunks("other start " * 90 + passage + " end")
    assert "".join(one) == "x" * 700 + passage
    assert len(set(one) & set(two)) >= 3
    assert bpe_reuse.chunks("") == [] and bpe_reuse.chunks("ab") == ["ab"]
    assert max(map(len, bpe_reuse.chunks("a" * 100000))) <= bpe_reuse.MAX


def test_round_trip(spark):
    draw = random.Random(6)
    passage = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(3000))
    texts = [*TEXTS, passage, "before " + passage, passage[500:] + " after", passage, passage.replace(" ", "")]
    library = Tokenizer.from_file(WORDS)
    out = bpe_reuse.encode_documents(table(spark, texts), WORDS).select("doc_id", "bpe_.*").collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_reuse.encode_documents(table(spark, []), WORDS).count() == 0


def test_packing(spark):
    texts = [*TEXTS, "many words go here and there " * 900]
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(packing.token_pieces(table(spark, texts), BYTES)).toPandas()
    by_piece = rows.set_index(["doc_id", "piece"])
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, p = 0, 0
        while (i, p) in by_piece.index:
            r = by_piece.loc[(i, p)]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at, p = at + r["length"], p + 1
            assert r["length"] <= 2048 and (p == 1 or r["length"] == 2048)
        assert at == len(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 2048
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert packing.pack(packing.token_pieces(table(spark, []), BYTES)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_items_and_helps(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([draw.randrange(1, 101), draw.randrange(34, 60)]) for _ in range(200)]
    first = packing.best_fit(lengths, 100)
    bins = packing.exchange(lengths, [list(b) for b in first], 100)
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    squares = lambda x: sum(sum(lengths[i] for i in b) ** 2 for b in x)
    assert len(bins) <= len(first) and squares(bins) >= squares(first)


def test_exchange_empties_a_bin():
    lengths = [6, 5, 5, 4, 4, 6]  # 6+4, 6+4, 5+5 is possible; the start wastes
    assert len(packing.exchange(lengths, [[0], [1, 3], [2, 4], [5]], 10)) == 3
