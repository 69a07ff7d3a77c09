"""Reads, alignments and variants made from the driver's tables, by expressions that mean the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.runtime import spread

ADAPTER = "AGATCGGAAG"
BARCODE = "CTGACTAC"
PRIMERS = ("ACGTACGGTCA", "TTGCAGTCAGG")
REFERENCE = "ACGTTGCATGCCATAGGCTTAACGATCGATTGCCAGTACGGATTACAGCTTGACCATGGACTTACGCATCGGATATCCGTGA"
RNAME = "ref1"

IN_READS = """
 event_id AS id,
 translate(concat(md5(CAST(event_id AS STRING)), md5(concat(CAST(event_id AS STRING), 'x'))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS body,
 translate(concat(md5(concat(CAST(event_id AS STRING), 'q')), md5(concat(CAST(event_id AS STRING), 'r')), md5(concat(CAST(event_id AS STRING), 's'))), '0123456789abcdef', '!#%5:?ABCDEFGHIJ') AS quals
"""
SEQUENCE = f"""concat(
 CASE WHEN id % 7 = 0 THEN repeat('G', CAST(id % 13 AS INT)) ELSE '' END,
 CASE WHEN id % 8 = 1 THEN '{BARCODE}' WHEN id % 8 = 2 THEN 'CTGTCTAC' WHEN id % 8 = 3 THEN 'CTGTCTAG' WHEN id % 8 = 4 THEN '{PRIMERS[0]}' ELSE '' END,
 CASE WHEN id % 9 = 0 THEN lower(substring(body, 1, CAST(20 + id % 20 AS INT))) WHEN id % 10 = 0 THEN replace(substring(body, 1, CAST(20 + id % 20 AS INT)), 'C', 'R') ELSE substring(body, 1, CAST(20 + id % 20 AS INT)) END,
 CASE WHEN id % 5 = 0 THEN '{ADAPTER}' WHEN id % 5 = 1 THEN 'AGATCCGAAG' WHEN id % 5 = 2 THEN 'CTTCCGATCT' WHEN id % 5 = 3 THEN 'GTAGTCAG' ELSE 'TGACCGTACGT' END,
 CASE WHEN id % 11 = 0 THEN repeat('G', CAST(id % 17 AS INT)) ELSE '' END)"""
HEADER = """CASE CAST(id % 9 AS INT)
 WHEN 0 THEN concat('ERR7340112.', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), ' NB551068:77 length=101')
 WHEN 1 THEN concat('ERR7340112.', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), '.', CAST(1 + id % 2 AS STRING), ' NB551068:77 length=101')
 WHEN 2 THEN concat('K00233:104:HJ:6:1213:', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), ':40877/', CAST(1 + id % 2 AS STRING))
 WHEN 3 THEN concat('VH00481:5:C7NTK:1:1410:', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), ':5509_', CAST(1 + id % 2 AS STRING), ':Y:0:GGCA+TTAC')
 WHEN 4 THEN concat('SRR5550123.', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), '_NB551068:77_length=101')
 WHEN 5 THEN concat('DRR0091822.', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), '.', CAST(1 + id % 2 AS STRING), '_NB551068:77_length=75')
 WHEN 6 THEN concat('plain', CAST(id AS STRING))
 ELSE concat('VH00481:5:C7NTK:1:1408:', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), ':7712 ', CAST(1 + id % 2 AS STRING), ':N:0:TTAG') END"""
READS = f"""CAST(1 + id % 2 AS INT) AS src, id AS ord,
 concat('M', CAST(CAST(floor(id / 2) AS BIGINT) % 7 AS STRING), ':5:C7NTK:1:1408:', CAST(CAST(floor(id / 2) AS BIGINT) AS STRING), ':7712 ', CAST(1 + id % 2 AS STRING), ':N:0:TTAG') AS header,
 {HEADER} AS dialect, {SEQUENCE} AS sequence, substring(quals, 1, length({SEQUENCE})) AS quality"""

IN_DUP = "doc_id AS id, md5(coalesce(text, '')) AS h"
DUP = """CAST(1 AS INT) AS src, id AS ord, concat('d', CAST(id AS STRING), chr(9), 'x') AS header,
 substring(translate(concat(h, md5(h)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 40) AS sequence,
 substring(translate(concat(md5(concat(h, 'q')), h), '0123456789abcdef', '!#%5:?ABCDEFGHIJ'), 1, 40) AS quality"""

IN_SAM = "l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS h, CAST(l_partkey % 23 AS INT) AS p, CAST(l_suppkey % 6 AS INT) AS k"
#: Each read copies the reference and changes some bases; its CIGAR is one of six, of 20 reference bases each.
SAM = f"""CAST((l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS BIGINT) AS ord,
 concat('M1:9:F:1:2:', CAST(l_orderkey AS STRING), ':5 ', CASE WHEN l_orderkey % 5 = 0 THEN '0' ELSE CAST(1 + l_linenumber % 2 AS STRING) END, ':N:0:A') AS qname,
 CAST(0 AS INT) AS flag, CASE WHEN p = 22 THEN '*' ELSE '{RNAME}' END AS rname, CAST(1 + p AS INT) AS pos, CAST(20 + l_linenumber AS INT) AS mapq,
 CASE k WHEN 0 THEN '20M' WHEN 1 THEN '8M2D10M' WHEN 2 THEN '9M2I11M' WHEN 3 THEN '3S20M' WHEN 4 THEN '2H20M4H' ELSE '9M1I11M' END AS cigar,
 CASE k WHEN 0 THEN ### WHEN 1 THEN concat(substring(###, 1, 8), substring(###, 11, 10)) WHEN 2 THEN concat(substring(###, 1, 9), translate(substring(h, 1, 2), '0123456789abcdef', 'AAAAAAACAAAAAAAA'), substring(###, 10, 11))
  WHEN 3 THEN concat('TTT', ###) WHEN 4 THEN ### ELSE concat(substring(###, 1, 9), 'A', substring(###, 10, 11)) END AS seq,
 substring(translate(concat(h, md5(h)), '0123456789abcdef', '!#%5:?ABCDEFGHIJ'), 1, CASE k WHEN 1 THEN 18 WHEN 2 THEN 22 WHEN 3 THEN 23 WHEN 5 THEN 21 ELSE 20 END) AS qual""".replace(
    "###",
    f"concat(substring('{REFERENCE}', CAST(1 + p AS INT), CAST(ascii(substring(h, 3, 1)) % 11 AS INT)), translate(substring(h, 4, 2), '0123456789abcdef', 'ACGTACGTACGTACGN'), substring('{REFERENCE}', CAST(3 + p + ascii(substring(h, 3, 1)) % 11 AS INT), CAST(18 - ascii(substring(h, 3, 1)) % 11 AS INT)))",
)

IN_TAGS = "p_partkey AS id"
TAGS = "CAST(id AS INT) AS row, CAST(id * 3 % 701 AS BIGINT) AS position, substring('ACGT', CAST(1 + id % 4 AS INT), 1) AS allele"
#: Each variant against the next few; the distance is a hash of the pair.
EDGES = "CAST(row AS INT) AS row, CAST(row + step AS INT) AS col, CAST(ascii(substring(md5(concat(CAST(row AS STRING), '|', CAST(row + step AS STRING))), 1, 1)) * 100 + ascii(substring(md5(concat(CAST(row AS STRING), '|', CAST(row + step AS STRING))), 2, 1)) - 4848 AS DOUBLE) / 5500.0 AS dist"
IN_REFS = "r_regionkey AS id"
REFS = "CAST(id AS INT) AS ref_ord, concat('region', CAST(id AS STRING), ' of five') AS name, translate(concat(md5(concat('r', CAST(id AS STRING))), md5(concat('s', CAST(id AS STRING)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS ref"

IN_TAG_READS = "c_custkey AS id"
#: Short reads and references, of letters that often agree, for alignments cell by cell.
TAG_READS = "CAST(id AS BIGINT) AS ord, concat('c', CAST(id AS STRING)) AS header, translate(substring(md5(concat('t', CAST(id AS STRING))), 1, CAST(5 + id % 6 AS INT)), '0123456789abcdef', 'AACCGGTTACGTAACC') AS sequence, CAST(NULL AS STRING) AS quality"
SHORT_REFS = "CAST(id AS INT) AS ref_ord, concat('s', CAST(id AS STRING)) AS name, translate(substring(md5(concat('u', CAST(id AS STRING))), 1, CAST(10 + id % 4 AS INT)), '0123456789abcdef', 'AACCGGTTACGTAACC') AS ref"
IN_PARTS = "s_suppkey AS id"
PARTS = "id, translate(concat(md5(concat('g', CAST(id AS STRING))), md5(concat('h', CAST(id AS STRING)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS ref"


def sql(table: str, inner: str, outer: str) -> str:
    return f"SELECT {outer} FROM (SELECT {inner} FROM {table})"


READS_SQL = sql("events", IN_READS, READS)
DUP_SQL = sql("documents", IN_DUP, DUP)
SAM_SQL = sql("lineitem", IN_SAM, SAM)
TAGS_SQL = sql("part", IN_TAGS, TAGS)
REFS_SQL = sql("region", IN_REFS, REFS)
TAGS_READ_SQL = sql("customer", IN_TAG_READS, TAG_READS)
SHORT_REFS_SQL = sql("region", IN_REFS, SHORT_REFS)
PARTS_SQL = sql("supplier", IN_PARTS, PARTS)
#: All parts end to end, in order; pieces are a part with half of the next one, so that each stands in one place only.
LONG_REF_SQL = f"SELECT string_agg(ref, '' ORDER BY id) AS ref FROM ({PARTS_SQL})"
PIECES_SQL = f"SELECT CAST(id AS BIGINT) AS ord, ref || coalesce(substring(lead(ref) OVER (ORDER BY id), 1, 32), '') AS sequence FROM ({PARTS_SQL})"
EDGES_SQL = f"SELECT {EDGES} FROM (SELECT row, step FROM ({TAGS_SQL}), (SELECT unnest(range(1, 6)) AS step)) WHERE row + step < (SELECT count(*) FROM part)"


def view(spark: SparkSession, sf_dir: str, table: str, inner: str, outer: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*split(inner))).selectExpr(*split(outer))


def split(expressions: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, quoted, now = [], 0, False, ""
    for c in expressions:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are dealt out, not what is made of them, so that digests are computed by all tasks."""
    dealt = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))
    return dealt.selectExpr(*split(IN_READS)).selectExpr(*split(READS))


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents", IN_DUP, DUP)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", IN_SAM, SAM)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", IN_TAGS, TAGS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark, sf_dir)
    n = own.count()
    return own.select("row", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step")).where(F.col("row") + F.col("step") < n).selectExpr(*split(EDGES))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "region", IN_REFS, REFS)


def tag_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer", IN_TAG_READS, TAG_READS)


def short_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "region", IN_REFS, SHORT_REFS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "supplier", IN_PARTS, PARTS)


def long_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one reference: one row, as long as the table has rows."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "ref"))), lambda x: x["ref"]), "")
    return parts(spark, sf_dir).agg(joined.alias("ref")).select(F.lit(0).alias("ref_ord"), F.lit("long").alias("name"), "ref")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parts(spark, sf_dir)
    later = own.select((F.col("id") - 1).alias("id"), F.substring("ref", 1, 32).alias("after"))  # numbers have no gaps
    return own.join(later, "id", "left").select(F.col("id").cast("long").alias("ord"), F.lit("p").alias("header"), F.concat("ref", F.coalesce("after", F.lit(""))).alias("sequence"), F.lit(None).cast("string").alias("quality"))
