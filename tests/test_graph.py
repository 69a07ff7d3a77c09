"""Components against a plain walk, with contraction in lots of any size."""

import os
import random

import pytest

from readloom import runtime
from readloom.operators import graph


def plain(edges):
    near, label = {}, {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for start in sorted(near):
        if start not in label:
            stack = [start]
            while stack:
                node = stack.pop()
                if node not in label:
                    label[node] = start
                    stack += near[node]
    return label


@pytest.mark.parametrize("held", [2, 7, 1 << 20])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    draw = random.Random(6)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 290)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    draw.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r["node"]: r["label"] for r in graph.components(df).collect()} == plain(edges)
    assert graph.components(df.limit(0)).count() == 0
    named = spark.createDataFrame([("x", "y"), ("z", "y"), ("p", "q")], "u string, v string")
    assert sorted(map(tuple, graph.components(named, "u", "v").collect())) == [("p", "p"), ("q", "p"), ("x", "x"), ("y", "x"), ("z", "x")]


def test_forgotten_copies_are_gone(spark):
    df = runtime.durable(spark.range(100))
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 100
    runtime.forget(df)
    assert not os.path.exists(path)


def test_no_round_broadcasts_all_nodes(spark, monkeypatch):
    """Checkpoints keep a guess of their size, by which tables of all nodes went through the driver."""
    from readloom.operators import graph, phase

    plans = []
    durable = graph.durable

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    monkeypatch.setattr(graph, "durable", watched)
    tags = spark.range(60).selectExpr("cast(id as int) as row", "id as position", "'A' as allele")
    edges = spark.range(59).where("id % 20 <> 19").selectExpr("cast(id as int) as row", "cast(id + 1 as int) as col", "0.1D as dist")
    found = phase.phases(tags, edges, 0.2)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert sorted((r["row"], r["phase"]) for r in found.collect()) == [(i, 1 + i // 20) for i in range(60)]
