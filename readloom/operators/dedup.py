"""Clusters of equal sequences: deflating reads to them, and inflating them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import runtime
from readloom.functions import bases, headers


def cluster_sizes(reads: DataFrame) -> DataFrame:
    """(sequence, size): one row per distinct sequence, combined before the shuffle."""
    return reads.groupBy("sequence").agg(F.count(F.lit(1)).alias("size"))


def clusters(reads: DataFrame) -> DataFrame:
    """(cluster_id, size, sequence): distinct sequences numbered from 0, larger first, then by sequence."""
    return runtime.ranked(cluster_sizes(reads), F.col("size").desc(), F.col("sequence"), name="cluster_id").select("cluster_id", "size", "sequence")


def members(reads: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster_id, src, ord, header, quality): the reads of each cluster as rows, however many there are.

    A join that can split a sequence which a large part of the reads share.
    """
    return reads.join(found.select("sequence", "cluster_id"), "sequence").select("cluster_id", "src", "ord", "header", "quality")


def deflate(reads: DataFrame) -> DataFrame:
    """(cluster_id, size, sequence, members): clusters with the headers and qualities of their reads in input order.

    The cluster file has all members of a cluster on one line, so here they are one array; where a cluster can be too
    large for that, ``clusters`` and ``members`` say the same in rows.
    """
    member = F.struct("src", "ord", "header", "quality")
    grouped = reads.groupBy("sequence").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    grouped = grouped.withColumn("members", F.transform("members", lambda m: F.struct(headers.without_tabs(m["header"]).alias("header"), m["quality"].alias("quality"))))
    return runtime.ranked(grouped, F.col("size").desc(), F.col("sequence"), name="cluster_id").select("cluster_id", "size", "sequence", "members")


def cluster_number(name):
    """The number in ``C<number>%...``; a name of another form fails the job."""
    number = F.regexp_extract(name, "^C([0-9]+)(%.*)?$", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("no cluster name: "), name)).cast("long")).otherwise(number.cast("long"))


def inflate(table: DataFrame, sequences: DataFrame) -> DataFrame:
    """(cluster_id, member, header, sequence, quality): a read for each member of each cluster that has a sequence.

    ``table`` is (cluster_id, members), ``sequences`` (ord, name, sequence). A name's suffix {c} stands for the
    reverse complement; of sequences that repeat a number the last counts; clusters without one are passed over.
    """
    named = sequences.select("ord", cluster_number(F.regexp_replace("name", r"\{c\}$", "")).alias("cluster_id"), F.when(F.endswith("name", F.lit("{c}")), bases.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"))
    last = named.groupBy("cluster_id").agg(F.max_by("sequence", "ord").alias("sequence"))
    rows = table.select("cluster_id", F.posexplode("members").alias("member", "m"))
    return rows.join(last, "cluster_id").select("cluster_id", "member", F.col("m.header"), "sequence", F.col("m.quality"))
