"""Connected components by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.runtime import durable, forget

#: Nodes whose edges a task contracts together.
HELD = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an undirected edge table: label is the smallest node reachable.

    Tasks first contract the edges that they read, so that long paths inside of a partition cost no round. A round takes the smallest label among the neighbours and then jumps along labels, so the rounds follow the
    logarithm of the longest path. Each is cut by a checkpoint; only whether anything changed reaches the driver. Joins are
    merges: the size of what is read from a checkpoint is a guess, by which tables of all nodes would be broadcast.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    apart = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias(a), F.col(b).alias(b))
    both = durable(contracted(apart, a, b).select(F.inline(ways)).distinct())
    kept = durable(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label")))
    labels = kept
    while True:
        near = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), labels.node == near.u).select("node", "label", F.least("label", "near").alias("next"))
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("jump"))
        step = step.join(heads.hint("merge"), step.next == heads["head"], "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next"))
        step = durable(step)
        if step.where("next <> label").isEmpty():
            forget(step)
            forget(both)
            return labels
        forget(kept)
        kept, labels = step, step.select("node", F.col("next").alias("label"))


def contracted(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges that join the same nodes: of each partition, or of each HELD nodes of it, one from every node to the smallest it is joined to."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(node):
            while (above := up.setdefault(node, node)) != node:
                up[node] = node = up[above]
            return node

        def told(types: list[pa.DataType]) -> pa.RecordBatch:
            rows = [(node, top(node)) for node in list(up)]
            rows = [r for r in rows if r[0] != r[1]]
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[a, b])

        types = None
        for batch in batches:
            types = [c.type for c in batch.columns]
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = sorted((top(u), top(v)))
                up[high] = low
            if len(up) >= HELD:
                yield told(types)
                up.clear()
        if up:
            yield told(types)

    return edges.mapInArrow(stars, edges.schema)
