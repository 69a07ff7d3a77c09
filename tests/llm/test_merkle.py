"""Manifests against plain trees, level by level."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path
from zlib import crc32

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same

from readloom.llm import common, merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """(root, siblings of each leaf)."""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
        for run in runs:
            for i in run:
                for x in members[i]:
                    proofs[x] += [nodes[j] for j in run if j != i]
        members = [[x for i in run for x in members[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], proofs


def plain(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof) of each row."""
    own = defaultdict(list)
    for r in rows:
        own[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(own[s], key=lambda x: x[:3])], arity) for s in names}
    root, above = tree([trees[s][0] for s in names], arity)
    return [(x[3], x[2], trees[s][0], root, "".join(p + up)) for s, up in zip(names, above) for x, p in zip(sorted(own[s], key=lambda x: x[:3]), trees[s][1])]


def rows_of(n, seed=3):
    draw = random.Random(seed)
    rows = [(i, f"s{i % 3}", draw.choice(["en", "en", "en", "de", "é", None]), i, "text " * (i % 5)) for i in range(n)]
    return [*rows, (None, None, "en", None, None), (None, None, "en", None, None), (3, "x", "en", 7, "again"), (3, "x", "en", 7, "again"), (7, "ü", "lone", None, "")]


@pytest.mark.parametrize("arity, stretch, fan_in, n", [(2, 4, 2, 150), (2, 4096, 1024, 60), (3, 9, 3, 120), (5, 5, 5, 77)])
def test_trees_and_proofs(spark, monkeypatch, arity, stretch, fan_in, n):
    monkeypatch.setattr(merkle, "STRETCH", stretch)
    monkeypatch.setattr(merkle, "FAN_IN", fan_in)
    monkeypatch.setattr(merkle, "BROADCAST_STARTS", 100 if n == 60 else 0)
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumn("leaf", merkle.leaf_of([F.col(c) for c in merkle.FIELDS]))
    done = merkle.manifest(docs, "leaf", arity=arity)
    again = done.withColumn("folded", merkle.folded(F.col("leaf"), F.struct("index", "width", "group_index", "groups", "proof"), arity)).collect()
    found = [((r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in again]
    assert sorted(found, key=str) == sorted(plain(rows, arity), key=str)
    assert all(r["folded"] == r["root"] for r in again)


def test_forests_merge_in_any_order():
    draw = random.Random(1)
    for arity in (2, 3, 4):
        for n in range(1, 30):
            leaves = [sha(str(i)) for i in range(n)]
            wanted = tree(leaves, arity)[0]
            cuts = sorted(draw.sample(range(n + 1), min(3, n)))
            parts = [range(a, b) for a, b in zip([0, *cuts], [*cuts, n]) if a < b]
            forests = [merkle.Forest(n, arity, {(level, i): x for level, i, x in merkle.unresolved(n, p[0], [leaves[i] for i in p], arity, draw.choice([1, 2, 60]))}) for p in parts]
            draw.shuffle(forests)
            whole = merkle.Forest(n, arity)
            for f in forests:
                whole.merge(f)
            assert list(whole.nodes.values()) == [wanted]


def test_query(spark, sf_dir):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in common.table(spark, sf_dir, "documents").collect()]
    wanted = {}
    for row, own, subroot, root, proof in plain(rows):
        tampered = crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
        wanted[row[0]] = (own, subroot, root, sha(proof), not tampered)
    out = merkle.op13_merkle_manifest(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in out} == wanted
    assert len(out) == len(rows) and {r["verified"] for r in out} == {True, False}
    assert all((r["folded_root"] == r["root"]) == r["verified"] and len(r["folded_root"]) == 64 for r in out)


def test_query_against_sql(spark, duck, sf_dir):
    same(merkle.op13_merkle_manifest(spark, sf_dir).toPandas(), duck.execute(merkle.OP13_SQL).df())


def test_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([], FIELDS).withColumn("leaf", merkle.leaf_of([F.col(c) for c in merkle.FIELDS]))
    assert merkle.manifest(docs, "leaf").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs.withColumn("proof", F.lit(1)), "leaf")
