"""Nulls, repeats, empty tables, and columns whose names clash with those that operators make or use inside."""

import public_tokenizers
import pytest

import corpus_pipeline
from readloom.llm import bpe_reuse, html_text, line_dedup, media, near_copies, packing, simhash, substring_dedup, token_counts, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["_doc", "_mark", "_gone", "_kept", "_other", "_other_mark", "_group", "_r1", "_r2", "_data", "_one", "_named", "_fp", "_pieces", "kept_text", "n_lines", "n_dropped", "removed", "fp", "component_id", "bpe", "n_tokens", "toxicity", "sequence_id", "offset", "piece", "length", "media", "carved", "id", "doc", "mark", "first", "part", "label"]
LONG = "Many words follow one another here, and more of them, over and over. " * 3
TEXTS = [(1, None), (2, ""), (3, LONG), (3, LONG), (3, "another text of the same document"), (None, LONG), (None, None), (4, f"{LONG}\nown line"), (5, "word " * 30_000), (6, LONG.upper())]


def docs(spark, rows=TEXTS):
    kind = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c} here" for c in CLASHING)) for r in rows], kind)


def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (5, 0), (None, 1), (3, 1), (6, None)], "doc_id long, toxic int")


KEEP_ALL = {
    "html": lambda spark, d: html_text.extract_text(d.withColumnRenamed("text", "html")).drop("text").withColumnRenamed("html", "text"),
    "tokens": lambda spark, d: token_counts.count_tokens(d, BYTES),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "bpe": lambda spark, d: bpe_reuse.encode_documents(d, WORDS),
    "toxicity": lambda spark, d: toxicity.score(d, toxicity.fit(d, labels(spark))),
    "passages": lambda spark, d: substring_dedup.dedup_substrings(d, min_words=10),
    "lines": lambda spark, d: line_dedup.dedup_lines(d),
    "media": lambda spark, d: media.sniff(d.withColumn("data", d.text.cast("binary")).withColumn("declared_type", d.text)),
}


@pytest.mark.parametrize("name", sorted(KEEP_ALL))
def test_all_rows_and_columns_stay(spark, name):
    out = KEEP_ALL[name](spark, docs(spark)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:40]) for r in out) == sorted((str(i), str(t)[:40]) for i, t in TEXTS)
    assert len(out) == len(TEXTS) and all(r[c] == f"{c} here" for r in out for c in CLASHING)
    assert len({c.lower() for c in out[0].asDict()}) == len(out[0])
    assert KEEP_ALL[name](spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, near_copies.keep_one])
def test_one_of_each_group_stays(spark, keep):
    d = docs(spark)
    out = keep(d).collect()
    assert out[0].__fields__ == d.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:20]) for r in out) == [(1, ""), (3, "Many words follow on"), (3, "another text of the "), (5, "word word word word ")] or keep is simhash.keep_one
    assert keep(docs(spark, [])).count() == 0


def test_packing_of_odd_rows(spark):
    d = docs(spark)
    pieces = packing.token_pieces(d, BYTES)
    out = packing.pack(pieces, keys=("doc_id", "piece"))
    rows = out.toPandas()
    assert set(rows["_group"]) == {"_group here"} and set(rows["sequence_id"]) == {"sequence_id here"} and set(rows["length_"]) == {"length here"}
    sequence, offset = next(c for c in rows if c.startswith("sequence_id_")), next(c for c in rows if c.startswith("offset_"))
    for _, own in rows.groupby(sequence):
        own = own.sort_values(offset)
        assert own["length"].sum() <= 2048 and own[offset].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert (rows["piece"] == 0).sum() == len(TEXTS)


def test_many_equal_rows_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    same = spark.createDataFrame([(1, 0, 900)] * 400, "doc_id long, piece int, length long")
    out = packing.pack(same).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (out["sequence_id"].to_numpy() >> 32).max() >= 5 and out["sequence_id"].nunique() <= 210


def test_carving_with_clashing_names(spark):
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
    df = spark.createDataFrame([(1, b"--" + gif, "x", "a", "b", "c"), (2, None, None, "a", "b", "c")], "id long, data binary, declared_type string, _data string, _one string, carved string")
    out = media.carve(media.sniff(df)).collect()
    assert [(r["id"], bytes(r["carved_"]), r["_data"], r["_one"], r["carved"]) for r in out] == [(1, gif, "a", "b", "c")]


def test_stages_over_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (TEXTS, []):
        d = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, d = d.columns, stage(spark, d, str(tmp_path))
            assert d.columns == columns
        out = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        assert (out.count() > 0) == bool(rows)
