"""SimHash, line and passage de-duplication against brute force, and the pipeline's stages."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom.llm import bloom, line_dedup, simhash, substring_dedup
from readloom.llm.common import components

KIND = "doc_id long, text string, fp long, kept_text string, removed string, _doc string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", "y", "z") for i, t in rows], KIND)


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7))) + draw.choice(["", "", "", "", ".", ","]) for _ in range(n))


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(items, linked):
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def near_texts():
    base = prose(600, 1).split()
    out = [(1000 + i, prose(80, 100 + i)) for i in range(20)] + [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "One"), (10, "one two"), (11, "A\x1cB c d e f")]
    for i in range(40):
        words = list(base)
        words[i * 7] = "changed"
        out.append((200 + i, " ".join(words)))
    return out + [(300 + i, " ".join(base)) for i in range(15)]


def test_fingerprints_and_components(spark):
    rows = near_texts()
    prints = {i: fingerprint(t) for i, t in rows}
    want = smallest_reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: r["fp_"] % 2**64 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want and got[0]["text"] is not None
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.keep_one(table(spark, [])).count() == 0


def test_repeated_and_null_keys(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, prose(60, 9)), (None, prose(60, 10)), (None, prose(60, 10)), (2, "a b c d e f g")]
    assert simhash.near_duplicates(table(spark, rows)).count() == 6
    kept = [(r["doc_id"], r["text"][:5]) for r in simhash.keep_one(table(spark, rows)).collect()]
    assert len(kept) == 3 and len([k for k in kept if k[0] is None]) == 1


@pytest.mark.parametrize("split, bits", [(simhash.SPLIT, 3), (4, 3), (4, 2), (4, 5)])
def test_links_lose_nothing(spark, monkeypatch, split, bits):
    """Fingerprints in chains of 1 to 4 bits, many sharing signatures: components as by all pairs, also of split signatures."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    draw = random.Random(8)
    values = set()
    for _ in range(40):
        v = draw.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for b in draw.sample(range(64), draw.randrange(1, 5)):
                v ^= 1 << b
    values = sorted(values)
    arr = np.array(values, "u8")
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= bits
    label = np.arange(len(values))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(values))])
        if (new == label).all():
            break
        label = new
    signed = arr.view("i8").tolist()
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits)
    root = {r["node"]: r["label"] for r in components(found).collect()}
    groups = {}
    for v, i in zip(signed, label):
        groups.setdefault(i, set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({root.get(v, v) for v in signed}) == len(groups)


def test_large_signatures_are_probed(monkeypatch):
    draw = random.Random(3)
    values = np.unique(np.array([draw.getrandbits(12) for _ in range(900)], "u8"))
    whole = simhash.nearest_roots(values, 1)
    monkeypatch.setattr(simhash, "COMPARED", 10)
    assert (simhash.nearest_roots(values, 1) == whole).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows, least=10):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            holders.setdefault(key(s), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= least and len(holders[key(s)]) > 1 and i != min(holders[key(s)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines(spark):
    draw = random.Random(1)
    pool = ["A repeated line.", " a REPEATED line.\t", "short", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "123456789", "1234567890", "", "x\r", "long " * 3000, "\x1cline with separators"]
    rows = [(i, None if i == 3 else "\n".join(draw.choice([*pool, f"own line {i}", f"own line {i}"]) for _ in range(draw.randrange(6)))) for i in range(60)]
    out = line_dedup.dedup_lines(table(spark, rows))
    assert out.columns == [*table(spark, rows).columns, "kept_text_", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["kept_text_"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == plain_lines(rows)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_lines_of_repeated_and_null_keys(spark):
    rows = [(2, "a line that repeats"), (2, "a line that repeats\nown"), (4, "a line that repeats"), (None, "a line that repeats\nz")]
    got = sorted((str(r["doc_id"]), r["kept_text_"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == [("2", "a line that repeats"), ("2", "a line that repeats\nown"), ("4", ""), ("None", "z")]


def test_lines_without_keys_are_documents_each(spark):
    rows = [(None, "a line that repeats\nx"), (None, "a line that repeats\ny"), (None, "a line that repeats\ny")]
    got = [r["kept_text_"] for r in line_dedup.dedup_lines(table(spark, rows)).collect()]
    assert sorted(got) in (["a line that repeats\nx", "y", "y"], ["a line that repeats\ny", "a line that repeats\ny", "x"])


@pytest.mark.parametrize("held, most", [(bloom.HELD, bloom.MOST_BITS), (500, bloom.MOST_BITS), (500, 1 << 12)])
def test_filter_never_misses(spark, monkeypatch, held, most):
    monkeypatch.setattr(bloom, "HELD", held)
    if most < bloom.LEAST_BITS:  # too small: it suspects too many, but misses none
        monkeypatch.setattr(bloom, "LEAST_BITS", most)
        monkeypatch.setattr(bloom, "MOST_BITS", most)
    keys = [f"key {i}" for i in range(3000)]
    texts = spark.createDataFrame([(" ".join(map(str, range(j, 3000, 3 + j))),) for j in range(4)], "text string").repartition(3)
    twice = bloom.twice_seen(texts, F.col("text"), lambda t: [f"key {i}".encode() for i in t.split()], F.size(F.split("text", " ")))
    often = {i for i in range(3000) if sum(i in range(j, 3000, 3 + j) for j in range(4)) > 1}
    hit = twice.suspects([k.encode() for k in keys])
    assert all(hit[i] for i in often)
    assert sum(hit) < len(often) + 30 or most < 1 << 20


def test_filter_of_hashes(spark):
    """It holds all that were given, and few others."""
    given, others = (np.random.default_rng(n).integers(-1 << 63, 1 << 63, 3000, "i8") for n in (1, 2))
    made = bloom.seen(spark.createDataFrame([(int(h),) for h in [*given, *given[:9]]], "h long"))
    assert made.holds(given.view("u8")).all() and made.holds(others.view("u8")).sum() < 9
    assert not bloom.seen(spark.createDataFrame([], "h long")).holds(others.view("u8")).any()


def test_filter_grows():
    shape = bloom.Shape(1 << 24)
    assert shape.slices == 64 and bloom.Shape(1 << 29).slices == 1024
    places = shape.places(np.arange(10000, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    assert places.min() >= 0 and places.max() < 1 << 24 and (places // (shape.bits // shape.slices) == (places // (shape.bits // shape.slices))[:, :1]).all()


PASSAGE = prose(70, 77)


def plain_units(text):
    """Words of each unit, by the rule read aloud: an end counts if LEAST_WORDS words or more came since the last."""
    from zlib import crc32

    out, unit, said, before = [], [], 0, None
    for line in (text or "").lower().split("\n"):
        for word in line.split():
            unit.append(word)
            said = said + 1 if word == before else 0
            before = word
            ends = word[-1] in ".!?" or crc32(word.encode()) % substring_dedup.CUT_EVERY == 0 or said and said % substring_dedup.SAID_OVER == 0
            if ends and len(unit) >= substring_dedup.LEAST_WORDS:
                out.append(unit)
                unit = []
        if len(unit) >= substring_dedup.LEAST_WORDS:
            out.append(unit)
            unit = []
    if unit:
        out[-1:] = [(out[-1] if out else []) + unit]
    return out


def plain_kept(rows, min_words, within):
    """The words that each row keeps, in the order of ``rows``."""
    rank = lambda i, t: (i is None, i if i is not None else xxhash_of(t))
    holders = {}
    for i, t in rows:
        for unit in plain_units(t):
            holders.setdefault(tuple(unit), set()).add(rank(i, t))
    out = []
    for i, t in rows:
        kept, run, seen = [], [], set()
        for unit in [*plain_units(t), None]:
            if unit is not None and (min(holders[tuple(unit)]) != rank(i, t) or within and tuple(unit) in seen):
                run += unit
                continue
            kept += run if len(run) < min_words else []
            kept += unit or []
            run = []
            seen |= {tuple(unit)} if unit else set()
        out.append(kept)
    return out


def xxhash_of(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("seed, min_words, within", [(1, 12, False), (2, 12, True), (3, 1, False), (4, 40, False), (5, 1, True)])
def test_passages_as_by_plain_version(spark, seed, min_words, within):
    """Random corpora of repeated and own passages; repeated and null keys, repeated rows, short lines, one word over and over."""
    draw = random.Random(seed)
    pool = [prose(draw.randrange(1, 80), 100 * seed + k) for k in range(6)] + ["Yes it is.", "so " * 50, "a: b\nc: d\ne", "\n", " \x1c ", "Éa É, é."]
    rows = []
    for k in range(60):
        parts = [draw.choice(pool) if draw.random() < 0.6 else prose(draw.randrange(1, 30), draw.random()) for _ in range(draw.randrange(5))]
        rows.append((draw.choice([k, k, k, draw.randrange(20), None]), draw.choice([" ", "\n"]).join(parts)))
    rows += [*rows[:6], (None, None), (3, "")]
    out = substring_dedup.dedup_substrings(table(spark, rows), min_words=min_words, within=within).collect()
    assert len(out) == len(rows)
    got, want = {}, {}
    for r in out:
        kept = r["text"] or ""
        for s in reversed(r["removed_"]):
            kept = kept[: s["start"]] + kept[s["end"] :]
        assert kept == r["kept_text_"]
        got.setdefault((r["doc_id"], r["text"]), set()).add(tuple(kept.lower().split()))
    for (i, t), words in zip(rows, plain_kept(rows, min_words, within)):
        want.setdefault((i, t), set()).add(tuple(words))
    assert got == want and any(r["removed_"] for r in out)


def test_passages(spark):
    rows = [(i, f"{prose(120, i)} {PASSAGE} {prose(90, 500 + i)}") for i in range(8)] + [(20 + i, prose(200, 900 + i)) for i in range(8)] + [(40, None), (41, ""), (42, "word " * 5000)]
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(table(spark, rows)).collect()}
    texts = dict(rows)
    assert len(out) == len(rows)
    assert out[0]["kept_text_"] == texts[0]
    middle = " ".join(PASSAGE.split()[9:-9])
    for i in range(1, 8):
        assert middle not in out[i]["kept_text_"]
        assert all(texts[i][s["start"] : s["end"]].strip() in texts[0] for s in out[i]["removed_"])
    assert all(out[20 + i]["kept_text_"] == texts[20 + i] for i in range(8))
    assert out[40]["kept_text_"] == "" == out[41]["kept_text_"] and out[42]["kept_text_"] == texts[42]
    assert substring_dedup.dedup_substrings(table(spark, [])).count() == 0


def test_units_cover_the_text():
    for text in ["", "\n\n", "a. b! c?\nd e", "no stop " * 100, "...", " x", prose(300, 5), "a.b.c d..e\n f", "so so so"]:
        ends, digests = substring_dedup.units(text)
        assert len(ends) == len(digests) and (ends[-1] if ends else 0) == len(text.split())
        assert all(b - a >= substring_dedup.LEAST_WORDS for a, b in zip([0, *ends], ends)) or len(ends) == 1


def test_one_word_over_and_over_is_cut():
    word = next(w for w in map(str, range(99)) if not substring_dedup.CHOSEN[w])
    ends, _ = substring_dedup.units(f"{word} " * 200)
    assert max(b - a for a, b in zip([0, *ends], ends)) < 8


def test_short_repeats_stay(spark):
    rows = [(1, "Yes it is. " + prose(40, 1)), (2, "Yes it is. " + prose(40, 2))]
    assert all(not r["removed_"] for r in substring_dedup.dedup_substrings(table(spark, rows)).collect())


def test_passages_of_repeated_and_null_keys(spark):
    first = prose(60, 31)
    own = {i: prose(60, 40 + i) for i in range(4)}
    rows = [(1, first), (2, f"{first}. {own[0]}"), (2, f"{own[1]}. {own[0]}"), (None, f"{first}. {own[2]}"), (None, own[3])]
    got = {r["text"]: r for r in substring_dedup.dedup_substrings(table(spark, rows)).collect()}
    assert len(got) == 5
    for i in (0, 2, 4):
        assert got[rows[i][1]]["kept_text_"] == rows[i][1] and not got[rows[i][1]]["removed_"]
    for i in (1, 3):
        assert got[rows[i][1]]["removed_"] and own[0 if i == 1 else 2] in got[rows[i][1]]["kept_text_"]
