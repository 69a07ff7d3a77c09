"""Mixes against a plain version that walks each source in order."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same

from readloom.llm import mixing

KIND = "doc_id long, text string, source string, size string, taken string, _tag string, _cell string"


def plain(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    words = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))
    own = defaultdict(list)
    for key, text, source in rows:
        place = hashlib.md5(":".join(x for x in ("0", None if key is None else str(key), hashlib.md5((text or "").encode()).hexdigest()) if x is not None).encode()).hexdigest()[:15]
        own[source].append((place, -1 if key is None else key, words(text), key))
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(x[2] for x in own[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, targets, free = share * sum(sizes.values()), {}, list(names)
    while free:  # the excess of those above their limit is shared out anew
        left = total - sum(targets.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= most * sizes[s]]
        targets |= {s: most * sizes[s] for s in over}
        if not over:
            targets |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        free = [s for s in free if s not in over]
    out = []
    for s in names:
        budget = int(targets[s])
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for *_, size, key in sorted(own[s], key=lambda x: x[:3]):
            more = max(0, min(size, rest))
            rest -= more
            out.append((key, size, sizes[s], round(targets[s], 6), size * whole + more))
    return sorted(out, key=str)


def got(df, size="size", source="source_size", target="target", taken="taken"):
    return sorted(((r["doc_id"], r[size], r[source], round(r[target], 6), r[taken]) for r in df.collect()), key=str)


def made(n):
    hot = [(i, "word " * (i * 37 % 91), "hot") for i in range(n)]
    return [*hot, *((n + i, f"a\tb\nc {i}" * (i % 7), f"s{i % 11}") for i in range(n // 4)), (None, None, None), (None, "x y", None), (None, "x y", None), (5, "x y\x1cz", "é"), (5, "x y\x1cz", "é"), (7, "", ""), (8, "one two", "")]


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_against_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = made(400)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], KIND).repartition(3)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
    assert got(out, "size_", taken="taken_") == plain(rows)
    assert {(r["size"], r["taken"], r["_tag"]) for r in out.collect()} == {("a", "b", "c")}


def test_limits_weights_and_empty_tables(spark):
    rows = made(60)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], KIND)
    for options in ({"weights": (1,), "share": 2.0}, {"weights": (0, 5), "share": 0.3}, {"share": 0.0}):
        assert got(mixing.mix(docs, **options), "size_", taken="taken_") == plain(rows, options.get("weights", (3, 1, 2)), options.get("share", 1.5))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert got(mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string"))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixture_holds_what_was_taken(spark):
    rows = made(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(int)
    for r in mixing.mixture(docs).collect():
        found = re.findall(r"[^\x20\x09-\x0d]+", r["taken_text"])
        assert len(found) == r["words"] and r["text"].startswith(r["taken_text"]) and r["epoch"] in (0, 1)
        taken[r["doc_id"], r["text"]] += r["words"]
    wanted = defaultdict(int)
    for r in mixing.mix(docs).where("taken > 0").collect():
        wanted[r["doc_id"], r["text"]] += r["taken"]
    assert taken == wanted


def test_query_against_sql(spark, duck, sf_dir):
    same(mixing.op12_source_mix(spark, sf_dir).toPandas(), duck.execute(mixing.OP12_SQL).df())
