import numpy as np
import pytest

import corpus_pipeline
import __spark_entry__ as entry
from readloom.llm import near_copies
from readloom.llm.common import components


def test_stages_over_the_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    from readloom.llm.common import durable

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("text is not null and n_chars <> char_length(text)").count() == 0
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert out["doc_id"].nunique() == before
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_near_copies_go(spark, sf_dir):
    """Copies with words changed throughout: of those alike in 0.8 of their five-word shingles one stays, others all stay."""
    import random

    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, near = [], []
    for g in range(60):
        base = [word() for _ in range(300)]
        copy = list(base)
        for i in range(5, 300, 60 if g % 2 else 12):  # 5 or 25 words
            copy[i] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        one, other = shingles(rows[-2][1]), shingles(rows[-1][1])
        near.append(len(one & other) / len(one | other) >= 0.8)
    rows += [(1000, rows[0][1].upper()), (1000, rows[2][1] + " more"), (None, word()), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [2 * g for g in range(60)] + [2 * g + 1 for g in range(60) if not near[g]] + [1001, None]
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, want))
    assert any(near) and not all(near)
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("group", [1 << 12, 16])
def test_large_bands_are_dealt_out(spark, monkeypatch, group):
    """However a band is dealt, whatever is surely alike ends in one group, and what has nothing in common stays apart."""
    monkeypatch.setattr(near_copies, "GROUP", group)
    draw, rows = np.random.default_rng(5), []
    bases = draw.integers(0, 256, (110, near_copies.BANDS * near_copies.ROWS))
    for n in range(400):  # band 1: ten large groups of near copies; band 2: a hundred texts unlike each other, and a copy of each
        band, kind = (1, n % 10) if n < 200 else (2, 10 + n % 100)
        sketch = bases[kind].copy()
        sketch[draw.integers(0, len(sketch), 6)] = draw.integers(0, 256, 6)
        rows.append((band, n, n.to_bytes(16, "big"), sketch.astype("u1").tobytes(), kind))
    kinds = {r[2]: r[4] for r in rows}
    banded = spark.createDataFrame([r[:4] for r in rows], "band long, first long, mark binary, sketch binary")
    links = near_copies.candidates(banded)
    assert all(kinds[bytes(r["a"])] == kinds[bytes(r["b"])] for r in links.collect())
    label = {bytes(r["node"]): bytes(r["label"]) for r in components(links).collect()}
    assert len(label) == len(rows) and len(set(label.values())) == 110
