"""Mixing of sources to target weights: hash-random keys, prefix sums of sizes within each source, a cut at its exact budget."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import common
from readloom.runtime import ranked

WORD = r"[^\x20\x09-\x0D]+"
#: A key has KEY_BITS random bits; a source's keys are cut into ranges by the top CELL_BITS of them.
KEY_BITS, CELL_BITS = 60, 16
#: Up to so many sources their plan is broadcast; the plan of more is joined by source and range of keys.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """The number of words: each becomes one letter, which are counted by taking them away."""
    marks = F.regexp_replace(text, WORD, "w")
    return (F.length(marks) - F.length(F.replace(marks, F.lit("w"), F.lit("")))).cast("long")


def random_key(key: Column, text: Column, seed: int) -> Column:
    """A number that stands for the row's place in its source, the same in every run."""
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.md5(text)))
    return F.conv(F.substring(name, 1, KEY_BITS // 4), 16, 10).cast("long")


def allotted(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``sources`` (tag, source_size) with ``target``: ``share`` of all sizes by weight, none over ``most`` times its size.

    Weights repeat in the order of tags. What a source can't take is shared out anew among those below their limit, in
    rounds that only bring two sums to the driver.
    """
    weighed = ranked(sources, F.col("tag"), name="nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = weighed.withColumns({"weight": weight.cast("double"), "most": F.col("source_size") * F.lit(float(most))})
    row = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = float(row["size"] or 0) * share
    left, among = total, row["weight"] or 0.0
    while True:
        full = F.col("most") * among <= F.col("weight") * left
        row = weighed.agg(F.sum(F.when(full, F.col("most"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        now = total - (row["taken"] or 0.0), row["weight"] or 0.0
        if now == (left, among):
            return weighed.select("tag", "source_size", F.when(full, F.col("most")).otherwise(F.try_divide(left * F.col("weight"), F.lit(among))).alias("target"))
        left, among = now


def cut_of(ranges: DataFrame, name: str) -> DataFrame:
    """Of (tag, range, words, rest, earlier): the range of each tag in which ``rest`` words end, and ``before``, the words ahead of it."""
    before = F.col("earlier") + F.sum("words").over(Window.partitionBy("tag").orderBy(name)) - F.col("words")
    return ranges.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` with size (words), source_size, target (its source's) and taken (words the mix takes, repeats counted).

    Sources, in the order of their code points and null last, get ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``most`` times its source's size. Every document goes into the mix as often as its source's
    whole size fits into the target; of the rest, documents go in once more in the order of a random key until the
    budget is used up, the last one in part. So a source's taken words are its target rounded down. Null texts have size
    0. Rows with equal keys and texts are told apart by size only, which gives equal rows equal chances. All rows and
    columns stay; clashing names get underscores.

    Only sums for ranges of keys are shuffled. Prefix sums over 256 wide ranges, and over the 256 ranges of one of them,
    name the range that holds a source's cut; its rows alone are sorted, a 65,536th of the source, so a source that
    holds most rows is no hot task.
    """
    tag, cell, order, size_ = common.fresh(docs, "_tag", "_cell", "_order", "_size")
    value = common.text_of(F.col(f"`{text}`"))
    name = F.col(f"`{source}`").cast("string")
    sized = docs.select("*", F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name)).alias(tag), n_words(value).alias(size_), random_key(F.col(f"`{key}`"), value, seed).alias(order))
    sized = sized.withColumn(cell, F.shiftright(order, KEY_BITS - CELL_BITS))

    cells = common.durable(sized.groupBy(F.col(tag).alias("tag"), F.col(cell).alias("cell")).agg(F.sum(size_).alias("words")))
    plan = allotted(cells.groupBy("tag").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    plan = plan.withColumn("whole", F.coalesce(F.expr("try_divide(floor(target), source_size)"), F.lit(0.0)).cast("long"))
    plan = plan.withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    wide = cells.withColumn("wide", F.shiftright("cell", CELL_BITS // 2)).groupBy("tag", "wide").agg(F.sum("words").alias("words"))
    wide = cut_of(wide.join(plan.select("tag", "rest"), "tag").withColumn("earlier", F.lit(0)), "wide").select(F.col("tag").alias("_t"), F.col("wide").alias("_w"), "rest", F.col("before").alias("earlier"))
    inside = cells.join(wide, (F.col("tag") == F.col("_t")) & (F.shiftright("cell", CELL_BITS // 2) == F.col("_w")))
    cuts = cut_of(inside, "cell").select("tag", F.col("cell").alias("cut"), "before")
    plan = common.durable(plan.join(cuts, "tag", "left"))

    names = dict(zip(("tag", "cell", "source_size", "target", "whole", "rest", "cut", "before"), common.fresh(docs, "_tag2", "_cell2", "_source_size", "_target", "_whole", "_rest", "_cut", "_before")))
    same = F.col(tag) == F.col(names["tag"])
    if plan.count() <= BROADCAST_SOURCES:
        planned = sized.join(F.broadcast(plan.select(*(F.col(c).alias(names[c]) for c in plan.columns))), same)
    else:
        each = cells.select("tag", "cell").join(plan, "tag")
        planned = sized.join(each.select(*(F.col(c).alias(names[c]) for c in each.columns)), same & (F.col(cell) == F.col(names["cell"])))
    p = {c: F.col(n) for c, n in names.items()}
    size = F.col(size_)
    shown = common.fresh(docs, "size", "source_size", "target", "taken")

    def rows(part: DataFrame, once_more: Column) -> DataFrame:
        values = (size, p["source_size"], p["target"], size * p["whole"] + once_more)
        return part.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.alias(n) for v, n in zip(values, shown)))

    at_cut = F.coalesce(F.col(cell) == p["cut"], F.lit(False))
    clear = rows(planned.where(~at_cut), F.when(F.col(cell) < p["cut"], size).otherwise(0))
    earlier = p["before"] + F.sum(size).over(Window.partitionBy(tag).orderBy(order, F.col(f"`{key}`"), size_).rowsBetween(Window.unboundedPreceding, 0)) - size
    return clear.unionByName(rows(planned.where(at_cut), F.greatest(F.lit(0), F.least(size, p["rest"] - earlier))))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with ``epoch`` (from 0), ``words`` and ``taken_text``.

    Where the budget ends inside a document, the text ends with the last word that is taken. See ``mix``.
    """
    mixed = mix(docs, key, text, **options)
    size, taken = mixed.columns[-4], mixed.columns[-1]
    epoch, words, whole, kept = common.fresh(mixed, "epoch", "words", "_times", "taken_text")
    common.bounded_batches(docs.sparkSession)

    @arrow_udf("string")
    def cut(texts: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if t is None else first_words(t, k) for t, k in zip(texts.to_pylist(), n.to_pylist())], pa.string())

    times = F.transform(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)) - 1), lambda e: F.struct(e.cast("int").alias(epoch), F.least(F.col(size), F.col(taken) - e * F.col(size)).alias(words)))
    each = mixed.where(F.col(taken) > 0).select(*(F.col(f"`{c}`") for c in docs.columns), size, F.inline(times))
    value = common.text_of(F.col(f"`{text}`"))
    part = cut(F.when(F.col(words) < F.col(size), value), F.col(words))
    return each.withColumn(whole, part).select(*(F.col(f"`{c}`") for c in docs.columns), epoch, words, F.coalesce(F.col(whole), value).alias(kept))


def first_words(text: str, n: int) -> str:
    end = 0
    for found, _ in zip(re.finditer(WORD, text), range(n)):
        end = found.end()
    return text[:end]


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights of 3, 1, 2 and 1.5 times their words; see mix."""
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, substring(md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source
), f AS (
  SELECT *, (SELECT sum(least(2e0 * o.source_size * s.weight, 2e0 * s.source_size * o.weight)) <= 1.5e0 * sum(o.source_size) * s.weight FROM s o) AS at_most FROM s
), t AS (
  SELECT source, source_size, CASE WHEN at_most THEN 2e0 * source_size ELSE
    ((SELECT 1.5e0 * sum(source_size) FROM f) - (SELECT coalesce(sum(2e0 * source_size), 0e0) FROM f WHERE at_most)) * weight / (SELECT sum(weight) FROM f WHERE NOT at_most) END AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(target) AS BIGINT) - whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS earlier
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * whole + greatest(0, least(size, rest - earlier)) AS BIGINT) AS taken FROM r
"""
