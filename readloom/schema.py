"""Row types of the library. Every scan states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: A read: which input it came from, its number there, and its three lines; FASTA records have no quality.
READ = T.StructType([
    T.StructField("src", T.IntegerType(), False),
    T.StructField("ord", T.LongType(), False),
    T.StructField("header", T.StringType(), False),
    T.StructField("sequence", T.StringType(), False),
    T.StructField("quality", T.StringType(), True),
])

SAM = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("qname", T.StringType(), False),
    T.StructField("flag", T.IntegerType(), False),
    T.StructField("rname", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("mapq", T.IntegerType(), False),
    T.StructField("cigar", T.StringType(), False),
    T.StructField("seq", T.StringType(), False),
    T.StructField("qual", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
])

#: A cluster of equal sequences: its number, size, and the headers and qualities of its members.
CLUSTER = T.StructType([
    T.StructField("cluster_id", T.LongType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("members", T.ArrayType(T.StructType([T.StructField("header", T.StringType()), T.StructField("quality", T.StringType())])), False),
])
