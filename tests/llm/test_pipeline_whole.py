"""The whole pipeline against a plain one: each plain stage works on what the plain stage before it gave."""

import public_tokenizers
from pyspark.sql import functions as F
from test_duplicates import plain_kept, plain_lines, smallest_reachable
from tokenizers import Tokenizer

import corpus_pipeline
from readloom.llm import toxicity


def plain_near(rows):
    """Of texts alike in 0.8 of their five-word shingles, links of links included, the row with the smallest number."""
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split())
    own = {i: shingles(t) for i, t in rows}
    linked = lambda i, j: len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])
    first = smallest_reachable([i for i, _ in rows], linked)
    return [(i, t) for i, t in rows if first[i] == i]


def test_as_by_plain_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    long = sorted((t or "" for _, t in base), key=lambda t: -len(t.split()))[:4]
    passage = " ".join(long[0].split()[20:90])
    extra = [(9001, long[1]), (9002, long[1].upper()), (9003, f"{long[2]} {passage} {long[3]}"), (9004, None), (9005, ""), (9006, f"one line of stock text\n{long[3]}"), (9007, f"one line of stock text\n{long[0]}")]
    rows = base + extra
    made = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~toxicity.held_out())))
    toxic = {r["doc_id"] for r in scored.where(F.col("toxicity.score") >= corpus_pipeline.REJECTED).collect()}
    plain = [(i, t) for i, t in rows if i not in toxic]
    lines = {i: kept for i, kept, *_ in plain_lines(plain)}
    plain = plain_near([(i, None if t is None else lines[i]) for i, t in plain])
    words = dict(zip([i for i, _ in plain], plain_kept(plain, 40, False)))

    stages, at = dict(corpus_pipeline.STAGES), docs
    for name in list(stages)[:-1]:
        at = stages[name](spark, at, str(tmp_path))
    kept = {r["doc_id"]: r["text"] for r in at.collect()}
    assert {i: (t or "").lower().split() for i, t in kept.items()} == words
    assert len(words) < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    sizes = out.groupby("doc_id")["length"].sum().to_dict()
    assert sizes == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 2048 and own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 1
