"""The cross-tokenizer alignment against token offsets compared pair by pair."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from readloom.llm import cross_tokens, token_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a", " ", "  two  spaces  ", "\n\nlines\n  and\ttabs\t\n", "end ", "end\t", "<|endoftext|> <s> </s> <unk> <0x0A>", "café Å ﬁ \U0001f600\U0001f600 中文字符  x　y",
    "▁ not a space", "x▁y", "\x00\x01\x7f", "word " * 3000, "unbroken" * 5000, "\r\n;\r\n{\r\r", "\x1c\x1d \x85   z", "it's we'll I'd 12345 67 !!! ... --", "\n" * 50 + " " * 50,
]


def plain(texts):
    """Per text: (n_a, n_b, groups as text, links), by comparing all byte ranges of neighbours."""
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters, names = {c: i for i, c in enumerate(token_counts.byte_letters())}, {i: t for t, i in tok.get_vocab().items()}
    byte_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for text in texts:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        own_a, own_b = [bytes(letters[c] for c in names[i]) for i in a], [byte_b(i) for i in b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(own_a) != whole or b"".join(own_b) != whole:
            out.append((0, 0, "", []))
            continue
        spans = []
        for own in (own_a, own_b):
            at, found = 0, []
            for x in own:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            k, m = i, j
            while k < len(a) and spans[0][k][1] <= cut:
                k += 1
            while m < len(b) and spans[1][m][1] <= cut:
                m += 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            links += [(a[x], b[y]) for x in range(i, k) for y in range(j, m) if max(spans[0][x][0], spans[1][y][0]) < min(spans[0][x][1], spans[1][y][1])]
            i, j = k, m
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def expected(rows):
    found = plain([t for _, t in rows])
    counts = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), (n_a, n_b, shown, links) in zip(rows, found):
        best = sum(counts[x] == most[x[1]] for x in links)
        sha = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
        out.append((key, n_a, n_b, shown.count(";") + 1 if shown else 0, len(links), best, sum(counts[x] for x in links), sha))
    return sorted(out, key=str), counts, most


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_texts_repeats_and_nulls(spark):
    rows = [*enumerate(ODD), (0, "a"), (0, "another"), (None, "a"), (None, None), (99, None), (98, "")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, block string, n_a string").repartition(3)
    wanted, counts, most = expected(rows)
    assert got(cross_tokens.align_documents(docs, A, B)) == wanted
    pairs = {(r["a"], r["b"]): (r["links"], r["best"]) for r in cross_tokens.pair_counts(docs, A, B).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    assert cross_tokens.align_documents(docs.limit(0), A, B).count() == 0
    named = spark.createDataFrame([("k", "some text")], "doc_id string, text string")
    assert cross_tokens.align_documents(named, A, B).first()["doc_id"] == "k"


def test_groups_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "tokenizers differ here", "g"), (2, None, "g"), (3, "x▁y", "g")], "doc_id long, text string, groups string")
    out = {r["doc_id"]: r for r in cross_tokens.aligned_groups(docs, A, B).collect()}
    assert out[2]["groups_"] == out[3]["groups_"] == [] and out[1]["groups"] == "g"
    shown = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in out[1]["groups_"])
    assert shown == plain(["tokenizers differ here"])[0][2]
    assert out[1]["groups_"][0]["start"] == 0 and out[1]["groups_"][-1]["end"] == len(" tokenizers differ here")


def test_query_over_whole_tables(spark, sf_dir):
    from readloom.llm import common

    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert got(cross_tokens.op11_cross_tokens(spark, sf_dir)) == expected(rows)[0]


def test_blocks_of_any_size_and_a_memory_that_forgets(monkeypatch):
    known = cross_tokens.remembered(A, B)
    monkeypatch.setattr(cross_tokens, "REMEMBERED", 50)
    monkeypatch.setattr(cross_tokens, "AT_ONCE", 3)
    import pyarrow as pa

    texts = ["one two three four five six seven", *ODD]
    for each in (1, 4, len(texts)):
        found = []
        for at in range(0, len(texts), each):
            block = cross_tokens.Block()
            for i, t in enumerate(texts[at : at + each]):
                block.add(i, t)
            row = block.row(0, known, pa.int64()).to_pylist()[0]
            found += zip(row["n_a"], row["n_b"], row["groups_sha256"])
        assert found == [(a, b, hashlib.sha256(s.encode()).hexdigest() if s else "") for a, b, s, _ in plain(texts)]
