"""Line de-duplication: once-seen and twice-seen Bloom filters, then exact confirmation of suspected repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from readloom.llm import bloom, common

BLANKS = b" \t\n\x0b\x0c\r"
#: Where documents without a key rank: after all others.
LAST = (1 << 63) - 1


def row_of(docs: DataFrame, key: str, text: str, doc: str, mark: str) -> list[Column]:
    """The document of a row, and a hash of its text: rows of one document are equal in both only if their texts are.

    Where no key comes twice, and at most one is missing, the hash is not needed and is 0.
    """
    several = not docs.groupBy(F.col(key).alias("id")).count().where("count > 1").isEmpty()
    told = F.xxhash64(common.text_of(text)) if several else F.lit(0).cast("long")
    return [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias(doc), told.alias(mark)]


def earliest(rows: DataFrame, *digest: str) -> DataFrame:
    """Of rows (doc, mark, *digest): (*digest, first, part) of each digest that several documents hold.

    ``first`` is the smallest document. Rows without a key are told apart by ``mark``; where all of a digest's are such,
    ``part`` is the smallest mark.
    """
    part = F.when(F.col("doc") == LAST, F.col("mark")).otherwise(0)
    found = rows.groupBy(*digest).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min(part).alias("part"), F.max(part).alias("top"))
    return found.where((F.col("first") != F.col("last")) | (F.col("first") == LAST) & (F.col("part") != F.col("top"))).select(*digest, "first", "part")


def foreign() -> Column:
    """Whether a row (doc, mark) is of another document than (first, part)."""
    return (F.col("doc") != F.col("first")) | (F.col("first") == LAST) & (F.col("mark") != F.col("part"))


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes: lower() takes A-Z only


def keys_of(text: str, least: int) -> list[bytes]:
    """The distinct keys of at least ``least`` code points, in order of first appearance."""
    keys = dict.fromkeys(map(line_key, text.encode("utf-8").split(b"\n")))
    return [k for k in keys if len(k) >= 4 * least or len(k) >= least and len(k.decode("utf-8")) >= least]


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(doc, mark, digest) of every line that a document loses: its key is in at least 2 documents, and not first here.

    ``mark`` tells the texts of one document apart.
    """
    common.bounded_batches(docs.sparkSession)
    value, newlines = common.text_of(text), F.replace(common.text_of(text), F.lit("\n"), F.lit(""))
    twice = bloom.twice_seen(docs, value, lambda value: keys_of(value, least), 1 + F.octet_length(value) - F.octet_length(newlines))
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys = [], []
            for value in batch.column(2):
                own = keys_of(value.as_py(), least)
                keys += own
                owners.append(len(own))
            hit = np.flatnonzero(shared.value.suspects(keys))
            at = np.repeat(np.arange(len(owners)), np.array(owners, "i8"))[hit]
            yield pa.record_batch([pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]), pa.array([digest(keys[i]) for i in hit], pa.binary())], names=["doc", "mark", "digest"])

    own = docs.select(*row_of(docs, key, text, "doc", "mark"), common.text_of(text).alias("text"))
    suspects = own.mapInArrow(suspected, "doc bigint, mark bigint, digest binary")
    confirmed = earliest(suspects, "digest").withColumnRenamed("digest", "known")
    confirmed = common.durable(confirmed)  # so that the join's hot digests can be split
    return suspects.join(confirmed, suspects.digest == confirmed.known).where(foreign()).select("doc", "mark", "digest")


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``docs`` with kept_text, n_lines (before dropping) and n_dropped; a clash of names appends underscores.

    A text is split at \\n; a line's key is the line stripped of \\x20 and \\x09-\\x0D, A-Z lower-cased. Keys of at
    least ``least`` code points that stand in at least 2 documents lose all their lines except in the smallest ``key``.
    Null and empty texts are one empty line. Rows that repeat a key are one document, each with its own result; rows
    without a key come after all others, each text a document of its own, equal ones alike. No row is lost.
    """
    drops = repeated_lines(docs, key, text, least).groupBy("doc", "mark").agg(F.collect_set("digest").alias("drops"))
    own, mark, gone, kept, other, other_mark = common.fresh(docs, "_doc", "_mark", "_gone", "_kept", "_other", "_other_mark")
    drops = drops.select(F.col("doc").alias(other), F.col("mark").alias(other_mark), F.col("drops").alias(gone))

    @arrow_udf("struct<text:string,lines:bigint,dropped:bigint>")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out, lines, dropped = [], [], []
        for value, lost in zip(texts, drops):
            every, lost = value.as_py().split("\n"), lost.as_py()
            stay = every
            if lost:
                lost = set(lost)
                stay = [x for x in every if digest(line_key(x.encode("utf-8"))) not in lost]
            out.append("\n".join(stay))
            lines.append(len(every))
            dropped.append(len(every) - len(stay))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "lines", "dropped"])

    joined = docs.select("*", *row_of(docs, key, text, own, mark)).join(drops, (F.col(own) == F.col(other)) & (F.col(mark) == F.col(other_mark)), "left")
    joined = joined.withColumn(kept, without(common.text_of(text), F.col(gone)))
    names = common.fresh(docs, "kept_text", "n_lines", "n_dropped")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{kept}.{f}").alias(n) for f, n in zip(("text", "lines", "dropped"), names)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its lines, those that it loses, and the digest of the rest; see dedup_lines."""
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), often AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, o.key IS NOT NULL AND l.doc_id <> o.first AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
