"""All queries outside the text operators, with the SQL that a second engine runs on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import runtime
from readloom.functions import bases, cigar, headers, quality
from readloom.operators import align, dedup, pairing, phase, preprocess, sam_merge, sampling, trimmer
from readloom.operators.trim import Clipping, clipping, primer_kmers, trim
from readloom.plans import views
from readloom.plans.trim_sql import VIEW, Steps
from readloom.sources import fastx, sam, sinks, xfl
from readloom.streaming.reads import trim_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


def trimmed(name: str, options: Clipping, steps: Steps, mask: bool = False) -> None:
    register(name, steps.result())(lambda spark, d: trim(views.reads(spark, d), options, mask).select("ord", "sequence", "quality"))


KMERS = primer_kmers(views.PRIMERS, 7, False)
FUZZY = primer_kmers(views.PRIMERS[:1], 8, True)

trimmed("recode", clipping(), Steps())
trimmed("preserve_bases", clipping(preserve_bases=True, hard_trim=1), Steps(preserve=True).hard(1, 1))
trimmed("polyg_left", clipping(polyg_trim=4, polyg_end="l"), Steps().polyg(4, None))
trimmed("polyg_right", clipping(polyg_trim=4, polyg_end="r"), Steps().polyg(None, 4))
trimmed("polyg_both", clipping(polyg_trim=3, polyg_right=6), Steps().polyg(3, 6))
trimmed("polyg_mask", clipping(polyg_trim=3), Steps(mask=True).polyg(3, 3), True)
trimmed("hard_clip", clipping(h_left=5, h_right=7), Steps().hard(5, 7))
trimmed("hard_clip_whole", clipping(hard_trim=18), Steps().hard(18, 18))
trimmed("hard_mask", clipping(h_left=5, h_right=40), Steps(mask=True).hard(5, 40), True)
trimmed("adapter_exact", clipping(adapter_trim=views.ADAPTER), Steps().adapter(views.ADAPTER, False))
trimmed("adapter_fuzzy", clipping(adapter_trim=views.ADAPTER, a_fuzzy=True), Steps().adapter(views.ADAPTER, True))
trimmed("adapter_mask", clipping(adapter_trim=views.ADAPTER, a_fuzzy=True), Steps(mask=True).adapter(views.ADAPTER, True), True)
for d in range(4):
    trimmed(f"barcode_h{d}", clipping(barcode_trim=views.BARCODE, b_hdist=d), Steps().barcode(views.BARCODE, d, None, None))
trimmed("barcode_window", clipping(barcode_trim=views.BARCODE, b_hdist=2, b_restrict=16, b_restrict_right=20), Steps().barcode(views.BARCODE, 2, 16, 20))
trimmed("barcode_one_side", clipping(barcode_trim=views.BARCODE, b_hdist=1, b_end="r"), Steps().barcode(views.BARCODE, 1, 0, None))
trimmed("barcode_mask", clipping(barcode_trim=views.BARCODE, b_hdist=1), Steps(mask=True).barcode(views.BARCODE, 1, None, None), True)
trimmed("primer_left", clipping(primer_trim=views.PRIMERS, p_kmer_length=7, p_end="l", p_restrict=25), Steps().primer("left", 25, KMERS, 7))
trimmed("primer_right", clipping(primer_trim=views.PRIMERS, p_kmer_length=7, p_end="r"), Steps().primer("right", 30, KMERS, 7))
trimmed("primer_both", clipping(primer_trim=views.PRIMERS, p_kmer_length=7, p_restrict_left=20, p_restrict_right=15), Steps().primer("left", 20, KMERS, 7).primer("right", 15, KMERS, 7))
trimmed("primer_fuzzy", clipping(primer_trim=views.PRIMERS[:1], p_kmer_length=8, p_fuzzy=True), Steps().primer("left", 30, FUZZY, 8).primer("right", 30, FUZZY, 8))
trimmed("primer_mask", clipping(primer_trim=views.PRIMERS, p_kmer_length=7), Steps(mask=True).primer("left", 30, KMERS, 7).primer("right", 30, KMERS, 7), True)

CHAIN = clipping(polyg_trim=3, adapter_trim=views.ADAPTER, a_fuzzy=True, primer_trim=views.PRIMERS, p_kmer_length=7, h_left=2, h_right=1)


def chain(mask: bool = False) -> Steps:
    s = Steps(mask=mask).start().polyg(3, 3).flagged("poly_g").start().adapter(views.ADAPTER, True).flagged("adapter")
    s.start().primer("left", 30, KMERS, 7).primer("right", 30, KMERS, 7).flagged("primer").start().hard(2, 1).flagged("hard")
    return s.add("SELECT *, hi - lo < full_length AS trimmed_any FROM PREV")


trimmed("trim_chain", CHAIN, chain())
trimmed("trim_chain_mask", CHAIN, chain(True), True)
MIN = 24
PAIRS = f"SELECT CAST(floor(ord / 2) AS BIGINT) AS pair_idx, ord, header, {VIEW} AS sequence, substring(quality, lo + 1, hi - lo) AS quality, trimmed_poly_g, trimmed_adapter, trimmed_primer, trimmed_hard, trimmed_any, hi - lo >= {MIN} AS kept FROM PREV"
SUM = "CAST(coalesce(sum(CASE WHEN {} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def sums(seen: str = "TRUE", widow: str = "FALSE") -> str:
    steps = {"poly_g": "trimmed_poly_g", "adapter": "trimmed_adapter", "barcode": "FALSE", "primer": "trimmed_primer", "hard": "trimmed_hard", "total_trimmed": "trimmed_any", "length_filtered": "NOT kept"}
    return "count(*) AS total_processed, " + ", ".join(f"{SUM.format(f'{c} AND {seen}')} AS {n}" for n, c in steps.items()) + f", {SUM.format(widow)} AS widow_filtered"


def side_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    """The reads as two inputs, by side, numbered from 0; the second lacks a last read if their number is odd."""
    every = views.reads(spark, d).select(*pairing.READ)
    return [every.where(F.col("src") == i).withColumn("ord", F.floor(F.col("ord") / 2)) for i in (1, 2)]


def whole_pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select(*pairing.READ)


def without_last(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("ord") < reads.agg(F.max("ord")).first()[0])


@register("trim_counts", chain().add(PAIRS).sql(sums()))
def trim_counts(spark: SparkSession, d: str) -> DataFrame:
    return trimmer.trimmer([views.reads(spark, d)], CHAIN, min_length=MIN).counts


@register("min_length", chain().add(PAIRS).sql("ord, sequence, quality", "WHERE kept"))
def min_length(spark: SparkSession, d: str) -> DataFrame:
    return trimmer.trimmer([views.reads(spark, d)], CHAIN, min_length=MIN).outputs[0].select("ord", "sequence", "quality")


WIDOWS = chain().add(PAIRS).add("SELECT *, bool_and(kept) OVER (PARTITION BY pair_idx) AS both_kept, bool_or(CASE WHEN ord % 2 = 0 THEN kept END) OVER (PARTITION BY pair_idx) AS first_kept FROM PREV")


@register("widow_filter", WIDOWS.sql("ord, header, sequence, quality", "WHERE both_kept"))
def widow_filter(spark: SparkSession, d: str) -> DataFrame:
    return trimmer.trimmer([whole_pairs(spark, d)], CHAIN, filter_widows=True, min_length=MIN).outputs[0].select("ord", "header", "sequence", "quality")


@register("widow_counts", WIDOWS.sql(sums("(ord % 2 = 0 OR first_kept)", "CASE WHEN ord % 2 = 0 THEN kept AND NOT both_kept ELSE NOT first_kept END")))
def widow_counts(spark: SparkSession, d: str) -> DataFrame:
    return trimmer.trimmer(side_inputs(spark, d), CHAIN, outputs=2, filter_widows=True, min_length=MIN).counts


def both_outputs(done: trimmer.Trimmed) -> DataFrame:
    first, second = done.outputs
    return first.unionByName(second).select("src", "ord", "header", "sequence", "quality")


OUTPUTS = "CAST(1 + ord % 2 AS INT) AS src, pair_idx AS ord, header, sequence, quality"


@register("trim_two_to_two", chain().add(PAIRS).sql(OUTPUTS, "WHERE kept"))
def trim_two_to_two(spark: SparkSession, d: str) -> DataFrame:
    return both_outputs(trimmer.trimmer(side_inputs(spark, d), CHAIN, outputs=2, min_length=MIN))


@register("trim_one_to_two", chain().add(PAIRS).sql(OUTPUTS, "WHERE kept"))
def trim_one_to_two(spark: SparkSession, d: str) -> DataFrame:
    return both_outputs(trimmer.trimmer([whole_pairs(spark, d)], CHAIN, outputs=2, min_length=MIN))


@register("trim_one_to_two_widows", WIDOWS.sql(OUTPUTS, "WHERE both_kept"))
def trim_one_to_two_widows(spark: SparkSession, d: str) -> DataFrame:
    return both_outputs(trimmer.trimmer([whole_pairs(spark, d)], CHAIN, outputs=2, filter_widows=True, min_length=MIN))


@register("trim_two_to_two_widows", WIDOWS.sql(OUTPUTS, "WHERE both_kept"))
def trim_two_to_two_widows(spark: SparkSession, d: str) -> DataFrame:
    return both_outputs(trimmer.trimmer(side_inputs(spark, d), CHAIN, outputs=2, filter_widows=True, min_length=MIN))


@register("trim_two_to_one_widows", WIDOWS.sql("ord, header, sequence, quality", "WHERE both_kept"))
def trim_two_to_one_widows(spark: SparkSession, d: str) -> DataFrame:
    return trimmer.trimmer(side_inputs(spark, d), CHAIN, filter_widows=True, min_length=MIN).outputs[0].select("ord", "header", "sequence", "quality")


def surplus_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two inputs of unequal length, every read in them: the second side's reads follow the first side's once more."""
    first, second = side_inputs(spark, d)
    return [first.unionByName(second.withColumn("ord", F.col("ord") + first.count())), second]


AGAIN = "(SELECT count(*) FROM events WHERE event_id % 2 = 0)"


@register("trim_surplus", chain().add(PAIRS).sql(f"unnest(CASE WHEN ord % 2 = 0 THEN [ord] ELSE [ord, 2 * (pair_idx + {AGAIN})] END) AS ord, sequence, quality", "WHERE kept"))
def trim_surplus(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs of unequal length into one output: the longer one's surplus stays."""
    return trimmer.trimmer(surplus_inputs(spark, d), CHAIN, min_length=MIN).outputs[0].select("ord", "sequence", "quality")


@register("trim_surplus_whole", chain().add(PAIRS).sql("ord, sequence, quality", f"WHERE kept AND (ord % 2 = 0 OR ord < (SELECT max(ord) FROM ({views.READS_SQL}) WHERE src = 2))"))
def trim_surplus_whole(spark: SparkSession, d: str) -> DataFrame:
    """As trim_surplus, where the last mate alone has no partner."""
    a, b = side_inputs(spark, d)
    return trimmer.trimmer([a, without_last(b)], CHAIN, min_length=MIN).outputs[0].select("ord", "sequence", "quality")


@register("interleave", f"SELECT ord, src, header, sequence, quality FROM ({views.READS_SQL})")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return pairing.interleave(pairing.zip_pairs(*side_inputs(spark, d))).select("ord", "src", "header", "sequence", "quality")


@register("deinterleave", f"SELECT src, CAST(floor(ord / 2) AS BIGINT) AS ord, header, sequence, quality FROM ({views.READS_SQL})")
def deinterleave(spark: SparkSession, d: str) -> DataFrame:
    pairs = pairing.deinterleave(whole_pairs(spark, d))
    return pairing.mates(pairs, 1).unionByName(pairing.mates(pairs, 2)).select("src", "ord", "header", "sequence", "quality")


@register("pair_zip_check", f"""WITH r AS (SELECT src, CAST(floor(ord / 2) AS BIGINT) AS pair_idx, header FROM ({views.READS_SQL})), z AS (SELECT * FROM r UNION ALL SELECT 1, pair_idx + {AGAIN}, header FROM r WHERE src = 2)
 SELECT pair_idx, max(CASE WHEN src = 1 THEN header END) AS h1, max(CASE WHEN src = 2 THEN header END) AS h2, CASE WHEN count(*) = 2 THEN 'pair' WHEN max(src) = 1 THEN 'extra first' ELSE 'extra second' END AS state FROM z GROUP BY pair_idx""")
def pair_zip_check(spark: SparkSession, d: str) -> DataFrame:
    pairs = pairing.zip_pairs(*surplus_inputs(spark, d), check=False).withColumn("fault", pairing.fault())
    state = F.when(F.col("fault").isNull(), F.lit("pair")).otherwise(F.regexp_extract("fault", "^(extra first|extra second)", 1))
    return pairs.select("pair_idx", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"), state.alias("state"))


@register("pair_zip_check_whole", f"SELECT CAST(floor(ord / 2) AS BIGINT) AS pair_idx, max(CASE WHEN src = 1 THEN header END) AS h1, max(CASE WHEN src = 2 THEN header END) AS h2, CASE WHEN count(*) = 2 THEN 'pair' WHEN max(src) = 1 THEN 'extra first' ELSE 'extra second' END AS state FROM (SELECT * FROM ({views.READS_SQL}) WHERE src = 1 OR ord < (SELECT max(ord) FROM ({views.READS_SQL}) WHERE src = 2)) GROUP BY ALL")
def pair_zip_check_whole(spark: SparkSession, d: str) -> DataFrame:
    """As pair_zip_check, where the last mate alone has no partner."""
    a, b = side_inputs(spark, d)
    pairs = pairing.zip_pairs(a, without_last(b), check=False).withColumn("fault", pairing.fault())
    state = F.when(F.col("fault").isNull(), F.lit("pair")).otherwise(F.regexp_extract("fault", "^(extra first|extra second)", 1))
    return pairs.select("pair_idx", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"), state.alias("state"))


ARCHIVED = "regexp_matches(split_part(dialect, ' ', 1), '^(SRR|DRR|ERR).*[.]')"
BARE = "split_part(dialect, '_', 1)"
SEVENTH = "CASE WHEN len(string_split(dialect, ':')) >= 8 THEN string_split(dialect, ':')[7] END"
MOLECULE_SQL = f"""
WITH r AS ({views.READS_SQL}), k AS (
 SELECT *, CASE WHEN contains(dialect, ' ') AND NOT {ARCHIVED} THEN 1 WHEN contains(dialect, ' ') THEN 2 WHEN contains(dialect, '/') THEN 3
  WHEN regexp_matches(dialect, '^(SRR|DRR|ERR).*[.]') THEN 4 WHEN contains({SEVENTH}, '_') THEN 5 ELSE 0 END AS kind,
  CASE WHEN contains(dialect, ' ') THEN split_part(dialect, ' ', 1) ELSE {BARE} END AS name, {SEVENTH} AS seventh FROM r
), m AS (
 SELECT *, CASE kind WHEN 1 THEN name WHEN 3 THEN split_part(dialect, '/', 1) WHEN 5 THEN array_to_string(string_split(dialect, ':')[1:6], ':') || ':' || split_part(seventh, '_', 1)
   WHEN 0 THEN NULL ELSE array_to_string(string_split(name, '.')[1:2], '.') END AS id,
  CASE kind WHEN 1 THEN substring(split_part(split_part(dialect, ' ', 2), ':', 1), 1, 1) WHEN 3 THEN substring(split_part(dialect, '/', 2), 1, 1) WHEN 5 THEN right(seventh, 1)
   WHEN 0 THEN NULL ELSE substring(string_split(name, '.')[3], 1, 1) END AS raw FROM k
)"""


@register("header_mol_id", MOLECULE_SQL + "SELECT ord, id, CASE WHEN kind = 0 THEN NULL WHEN raw IN ('0', '1', '2', '3') THEN raw ELSE '0' END AS side FROM m")
def header_mol_id(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", headers.molecule(F.col("dialect")).alias("m")).select("ord", "m.id", "m.side")


@register("header_fix_sra", MOLECULE_SQL + "SELECT ord, CASE WHEN kind IN (2, 4) AND len(string_split(name, '.')) = 2 THEN name || '.' || CAST(src AS STRING) || substring(dialect, length(name) + 1) ELSE dialect END AS header FROM m")
def header_fix_sra(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", headers.repaired(F.col("dialect"), F.col("src")).alias("header"))


@register("merged_qname", MOLECULE_SQL + """SELECT ord, CASE kind WHEN 1 THEN name || ' 3' || substring(dialect, length(name) + strpos(substring(dialect, length(name) + 1), ':')) WHEN 3 THEN id || '/3'
 WHEN 5 THEN id || '_3:' || array_to_string(string_split(dialect, ':')[8:], ':') WHEN 0 THEN dialect ELSE id || '.3' || substring(dialect, length(name) + 1) END AS qname FROM m""")
def merged_qname(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", headers.merged_name(F.col("dialect")).alias("qname"))


SCORES = "list_transform(range(1, length(quality) + 1), lambda i: ascii(substring(quality, i, 1)) - 33)"


@register("read_q_mean", f"SELECT ord, round(CAST(list_sum({SCORES}) AS DOUBLE) / length(quality), 3) AS q FROM ({views.READS_SQL})")
def read_q_mean(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", F.round(quality.mean(F.col("quality")).cast("double"), 3).alias("q"))


@register("read_q_median", f"SELECT ord, CAST(list_median({SCORES}) AS DOUBLE) AS q FROM ({views.READS_SQL})")
def read_q_median(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", quality.median(F.col("quality")).cast("double").alias("q"))


@register("kmer_set", f"""WITH r AS ({views.REFS_SQL}), s AS (SELECT ref AS s FROM r UNION ALL SELECT reverse(translate(ref, 'ACGT', 'TGCA')) FROM r)
 SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(s) - 4), lambda i: substring(s, i, 6))) AS kmer FROM s WHERE length(s) >= 6) GROUP BY kmer""")
def kmer_set(spark: SparkSession, d: str) -> DataFrame:
    both = views.references(spark, d).select(F.explode(F.array("ref", bases.reverse_complement(F.col("ref")))).alias("s"))
    return both.select(F.explode(bases.windows(F.col("s"), 6)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@register("kmer_membership", f"""WITH r AS ({views.REFS_SQL}), k AS (SELECT DISTINCT unnest(list_transform(range(1, length(ref) - 4), lambda i: substring(ref, i, 6))) AS kmer FROM r)
 SELECT ord, count(*) AS hits FROM (SELECT ord, unnest(list_transform(range(1, length(sequence) - 4), lambda i: substring(sequence, i, 6))) AS kmer FROM ({views.READS_SQL})) JOIN k USING (kmer) GROUP BY ord""")
def kmer_membership(spark: SparkSession, d: str) -> DataFrame:
    known = views.references(spark, d).select(F.explode(bases.windows(F.col("ref"), 6)).alias("kmer")).distinct()
    own = views.reads(spark, d).select("ord", F.explode(bases.windows(F.col("sequence"), 6)).alias("kmer"))
    return own.join(known, "kmer", "left_semi").groupBy("ord").agg(F.count(F.lit(1)).alias("hits"))


@register("revcomp", f"SELECT ord, reverse(translate(sequence, 'ACGTNRacgtn', 'TGCANYtgcan')) AS sequence, reverse(quality) AS quality FROM ({views.READS_SQL})")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).select("ord", bases.reverse_complement(F.col("sequence")).alias("sequence"), F.reverse("quality").alias("quality"))


DEFLATED = f"SELECT sequence, count(*) AS size, string_agg(replace(header, chr(9), ' ') || chr(9) || quality, chr(9) ORDER BY ord) AS members FROM ({views.DUP_SQL}) GROUP BY sequence"
NUMBERED = f"SELECT row_number() OVER (ORDER BY size DESC, sequence) - 1 AS cluster_id, * FROM ({DEFLATED})"


@register("dedup_deflate", f"SELECT cluster_id, size, sequence FROM ({NUMBERED})")
def dedup_deflate(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(views.duplicated(spark, d))


@register("dedup_members", f"SELECT n.cluster_id, r.ord, r.header, r.quality FROM ({views.DUP_SQL}) r JOIN ({NUMBERED}) n USING (sequence)")
def dedup_members(spark: SparkSession, d: str) -> DataFrame:
    own = views.duplicated(spark, d)
    return dedup.members(own, dedup.clusters(own)).select("cluster_id", "ord", "header", "quality")


@register("xfl_text", f"SELECT cluster_id, 'C' || cluster_id || '%' || size || chr(9) || members AS text FROM ({NUMBERED})")
def xfl_text(spark: SparkSession, d: str) -> DataFrame:
    return xfl.rendered(dedup.deflate(views.duplicated(spark, d)))


@register("inflate_roundtrip", f"SELECT replace(header, chr(9), ' ') AS header, sequence, quality FROM ({views.DUP_SQL})")
def inflate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    done = dedup.deflate(views.duplicated(spark, d))
    table = xfl.parsed(xfl.rendered(done), "text")
    sequences = done.select(F.col("cluster_id").alias("ord"), xfl.cluster_name().alias("name"), "sequence")
    return dedup.inflate(table, sequences).select("header", "sequence", "quality")


@register("fastq_text", f"SELECT ord, '@' || header || chr(10) || sequence || chr(10) || '+' || chr(10) || quality AS text FROM ({views.READS_SQL})")
def fastq_text(spark: SparkSession, d: str) -> DataFrame:
    return fastx.rendered(views.reads(spark, d))


@register("gzip_file_roundtrip", f"SELECT src, CAST(floor(ord / 2) AS BIGINT) AS ord, header, sequence, quality FROM ({views.READS_SQL})")
def gzip_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All reads written as two ordered gzip files of many members, and scanned again by ranges of their bytes."""
    folder = f"{runtime.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    paths = [f"{folder}/{i}.fq.gz" for i in (1, 2)]
    for side, path in zip(side_inputs(spark, d), paths):
        sinks.write_file(fastx.rendered(side), path)
    first, second = fastx.scan_paired(spark, *paths)
    read = runtime.durable(first.unionByName(second))
    sinks.delete(spark, folder)
    return read


@register("sam_text", f"SELECT ord, concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', '0', '0', seq, qual) AS text FROM ({views.SAM_SQL})")
def sam_text(spark: SparkSession, d: str) -> DataFrame:
    return sam.rendered(views.alignments(spark, d))


PREPARE = clipping(polyg_trim=3, adapter_trim=views.ADAPTER)
PREPARED = (
    Steps().polyg(3, 3).adapter(views.ADAPTER, False)
    .add(f"SELECT src, ord, header, length(sequence) AS raw_length, {VIEW} AS sequence, substring(quality, lo + 1, hi - lo) AS quality FROM PREV")
    .add(f"SELECT *, raw_length >= 30 AS long_raw, raw_length >= 30 AND length(sequence) > 0 AND length(sequence) >= 30 AS long_clipped, CAST(list_sum({SCORES}) AS DOUBLE) / length(quality) AS q FROM PREV")
)
PREPARED.add("SELECT *, long_clipped AND q >= 20 AS passed FROM PREV")


def prepared(spark: SparkSession, d: str, widows: bool = False) -> tuple[DataFrame, DataFrame]:
    return preprocess.preprocess(side_inputs(spark, d), PREPARE, 30, 20, enforce_clipped=True, filter_widows=widows)


LOG_KEYS = ["NUMBER_INPUT_FILES", "OBSERVED_RAW_READS_OR_R1", "OBSERVED_R2_READS", "OBSERVED_MAX_READ_LEN", "OBSERVED_MAX_CLIPPED_READ_LENGTH", "OBSERVED_MAX_QUALITY", "READ_COUNT_PASSING_ONLY_LENGTH_FILTER", "READ_COUNT_PASSING_ALL_QUALITY_CONTROL_FILTERS", "READ_PATTERN_COUNT_PASSING", "MIN_PHRED_QUALITY_THRESHOLD", "MIN_READ_LENGTH_THRESHOLD", "QUALITY_MEASURE"]
LOG_VALUES = ["'2'", "sum(CASE WHEN src = 1 THEN 1 ELSE 0 END)", "sum(CASE WHEN src = 2 THEN 1 ELSE 0 END)", "max(raw_length)", "max(CASE WHEN long_raw THEN length(sequence) END)", "regexp_replace(CAST(CAST(max(CASE WHEN long_clipped THEN q END) AS FLOAT) AS VARCHAR), '[.]0$', '')", "sum(CASE WHEN long_clipped THEN 1 ELSE 0 END)", "sum(CASE WHEN passed THEN 1 ELSE 0 END)", "count(DISTINCT CASE WHEN passed THEN sequence END)", "'20'", "'30'", "'average'"]


@register("preprocess_log", PREPARED.sql("unnest([" + ", ".join(f"'{k}'" for k in LOG_KEYS) + "]) AS key, unnest([" + ", ".join(f"CAST({v} AS STRING)" for v in LOG_VALUES) + "]) AS value"))
def preprocess_log(spark: SparkSession, d: str) -> DataFrame:
    stored, figures = prepared(spark, d)
    return preprocess.log(stored, figures, 2, 30, 20).select("key", "value")


@register("preprocess_max_quality", PREPARED.sql("round(max(CASE WHEN long_clipped THEN q END), 3) AS q"))
def preprocess_max_quality(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d)[1].select(F.round(F.col("q_max").cast("double"), 3).alias("q"))


@register("preprocess_clusters", PREPARED.sql("sequence, count(*) AS size", "WHERE passed GROUP BY sequence"))
def preprocess_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_sizes(prepared(spark, d)[0])


@register("preprocess_widows", PREPARED.add("SELECT *, bool_and(passed) OVER (PARTITION BY floor(ord / 2)) AS both_passed FROM PREV").sql("CAST(floor(ord / 2) AS BIGINT) AS ord, src, sequence", "WHERE both_passed"))
def preprocess_widows(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d, True)[0].select("ord", "src", "sequence")


def lot(key: str):
    """A lot that the second engine can draw too: the first 15 hex digits of a hash, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("lot"))), 1, 15), 16, 10).cast("long")


LOT = "substring(md5(concat(CAST({} AS STRING), 'lot')), 1, 15)"


@register("sample_exact", f"SELECT ord, sequence FROM ({views.READS_SQL}) ORDER BY {LOT.format('ord')}, ord LIMIT 137")
def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_exact(views.reads(spark, d), 137, "ord", lot=lot("ord")).select("ord", "sequence")


@register("sample_percent", f"SELECT ord, sequence FROM ({views.READS_SQL}) QUALIFY row_number() OVER (ORDER BY {LOT.format('ord')}, ord) <= (SELECT count(*) * 20 // 100 FROM events)")
def sample_percent(spark: SparkSession, d: str) -> DataFrame:
    every = views.reads(spark, d)
    return sampling.sample_exact(every, every.count() * 20 // 100, "ord", lot=lot("ord")).select("ord", "sequence")


@register("sample_pairs", f"SELECT ord, sequence FROM ({views.READS_SQL}) WHERE floor(ord / 2) IN (SELECT p FROM (SELECT DISTINCT CAST(floor(event_id / 2) AS BIGINT) AS p FROM events) ORDER BY {LOT.format('p')}, p LIMIT 50)")
def sample_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = pairing.deinterleave(whole_pairs(spark, d))
    return pairing.interleave(sampling.sample_exact(pairs, 50, "pair_idx", lot=lot("pair_idx"))).select("ord", "sequence")


@register("sample_overtarget", f"SELECT ord, sequence FROM ({views.READS_SQL})")
def sample_overtarget(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_exact(views.reads(spark, d), 1 << 40, "ord").select("ord", "sequence")


@register("sample_bernoulli", f"SELECT ord, sequence FROM ({views.READS_SQL}) WHERE {LOT.format('ord')} < '400000000000000'")
def sample_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_fraction(views.reads(spark, d), 25, "ord", lot=lot("ord"), bits=60).select("ord", "sequence")


@register("sample_reservoir", f"SELECT ord, sequence, (SELECT count(*) FROM events) AS seen FROM ({views.READS_SQL}) ORDER BY {LOT.format('ord')}, ord LIMIT 250")
def sample_reservoir(spark: SparkSession, d: str) -> DataFrame:
    kept, seen = sampling.sample_reservoir(views.reads(spark, d), 250, "ord", lot=lot("ord"))
    return kept.select("ord", "sequence", F.lit(seen).cast("long").alias("seen"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return views.alignments(spark, d)


# Pairs for the second engine: slots by side or arrival, the first of each; bases by reference position with
# the six CIGARs spelled out as a template of (reference offset, query offset) steps.
PAIR_SQL = f"""
WITH a AS (SELECT *, split_part(split_part(qname, ' ', 1), ':', 6) AS mol, substring(split_part(qname, ' ', 2), 1, 1) AS side FROM ({views.SAM_SQL}) WHERE rname = '{views.RNAME}'),
b AS (SELECT *, CASE WHEN side IN ('1', '2') THEN CAST(side AS INT) WHEN row_number() OVER (PARTITION BY mol ORDER BY ord) = 1 THEN 1 ELSE 2 END AS slot FROM a),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY mol, slot ORDER BY ord) = 1),
p AS (SELECT x.mol FROM c x JOIN c y ON x.mol = y.mol AND x.slot = 1 AND y.slot = 2),
w AS (SELECT c.*, CASE cigar WHEN '8M2D10M' THEN substring(seq, 1, 8) || '--' || substring(seq, 9, 10) WHEN '9M2I11M' THEN substring(seq, 1, 9) || substring(seq, 12, 11)
   WHEN '3S20M' THEN substring(seq, 4, 20) WHEN '9M1I11M' THEN substring(seq, 1, 9) || substring(seq, 11, 11) ELSE seq END AS aln,
  CASE cigar WHEN '9M2I11M' THEN substring(seq, 10, 2) WHEN '9M1I11M' THEN substring(seq, 10, 1) END AS ins FROM c JOIN p USING (mol)),
s AS (SELECT mol, slot, pos - 1 + i AS r, substring(aln, CAST(i + 1 AS BIGINT), 1) AS base, CASE WHEN i = 8 THEN ins END AS ins, i + 1 < length(aln) AS more FROM (SELECT *, unnest(range(0, length(aln))) AS i FROM w)),
t AS (SELECT x.mol AS xm, y.mol AS ym, x.base AS x, y.base AS y, x.ins AS i, y.ins AS j, x.more AS xmore, y.more AS ymore, substring('{views.REFERENCE}', CAST(coalesce(x.r, y.r) + 1 AS BIGINT), 1) AS f
   FROM (SELECT * FROM s WHERE slot = 1) x FULL JOIN (SELECT * FROM s WHERE slot = 2) y ON x.mol = y.mol AND x.r = y.r)
"""
BOTH = "x IS NOT NULL AND y IS NOT NULL"
LONE = "((i IS NOT NULL AND j IS NULL AND y IS NOT NULL AND ymore) OR (j IS NOT NULL AND i IS NULL AND x IS NOT NULL AND xmore))"


@register("sam_merge_stats", PAIR_SQL + f"""SELECT {SUM.format(BOTH)} AS observations, {SUM.format(f"{BOTH} AND x = y AND (x = '-' OR x <> f)")} AS true_variations,
 {SUM.format(f"{BOTH} AND x <> y")} AS variant_errors, {SUM.format(f"{BOTH} AND x <> y AND (x = '-' OR y = '-')")} AS deletion_errors,
 {SUM.format(f"(i IS NOT NULL AND j IS NOT NULL) OR {LONE}")} AS insert_obs, {SUM.format(f"(i IS NOT NULL AND j IS NOT NULL AND i <> j) OR {LONE}")} AS insert_errors FROM t""")
def sam_merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return sam_merge.merge_sam(aligned(spark, d), views.RNAME, views.REFERENCE)[1]


@register("sam_pairs", PAIR_SQL + "SELECT mol, coalesce(max(CASE WHEN slot = 1 THEN ord END), -1) AS o1, coalesce(max(CASE WHEN slot = 2 THEN ord END), -1) AS o2 FROM c GROUP BY mol")
def sam_pairs(spark: SparkSession, d: str) -> DataFrame:
    mol = F.get(F.split("mol", ":"), F.lit(5))
    return sam_merge.pair_up(aligned(spark, d), views.RNAME).select(mol.alias("mol"), F.coalesce("r1.ord", F.lit(-1)).alias("o1"), F.coalesce("r2.ord", F.lit(-1)).alias("o2"))


# Merged rows for the second engine: bases, qualities and insertions laid along every reference position of a pair.
LAID = """CASE cigar WHEN '8M2D10M' THEN substring({0}, 1, 8) || '{1}{1}' || substring({0}, 9, 10) WHEN '9M2I11M' THEN substring({0}, 1, 9) || substring({0}, 12, 11)
   WHEN '3S20M' THEN substring({0}, 4, 20) WHEN '9M1I11M' THEN substring({0}, 1, 9) || substring({0}, 11, 11) ELSE {0} END"""
INSERTED = "CASE cigar WHEN '9M2I11M' THEN substring({0}, 10, 2) WHEN '9M1I11M' THEN substring({0}, 10, 1) END"
ACGT = "{} IN ('A', 'C', 'G', 'T')"
RECORDS_SQL = PAIR_SQL + f""",
 v AS (SELECT c.*, {LAID.format('seq', '-')} AS aln, {LAID.format('qual', '!')} AS qal, {INSERTED.format('seq')} AS ins, {INSERTED.format('qual')} AS insq,
   CASE cigar WHEN '3S20M' THEN 3 WHEN '2H20M4H' THEN 2 ELSE 0 END AS front, CASE cigar WHEN '2H20M4H' THEN 4 ELSE 0 END AS back, pos - 1 AS s0, pos + 19 AS e0 FROM c JOIN p USING (mol)),
 h AS (SELECT x.mol, x.ord, x.qname, x.rname, least(x.s0, y.s0) AS s, greatest(x.e0, y.e0) AS e, (x.mapq + y.mapq) // 2 AS mapq,
   greatest(0, x.front - (x.s0 - least(x.s0, y.s0)), y.front - (y.s0 - least(x.s0, y.s0))) AS front, greatest(0, x.back - (greatest(x.e0, y.e0) - x.e0), y.back - (greatest(x.e0, y.e0) - y.e0)) AS back
   FROM v x JOIN v y ON x.mol = y.mol AND x.slot = 1 AND y.slot = 2),
 g AS (SELECT mol, unnest(range(s, e)) AS r FROM h),
 k AS (SELECT mol, slot, s0 + i AS r, substring(aln, CAST(i + 1 AS BIGINT), 1) AS base, substring(qal, CAST(i + 1 AS BIGINT), 1) AS q, CASE WHEN i = 8 THEN ins END AS ins, CASE WHEN i = 8 THEN insq END AS insq, i < 19 AS more
   FROM (SELECT *, unnest(range(0, 20)) AS i FROM v)),
 m AS (SELECT g.mol, g.r, x.base AS x, y.base AS y, x.q AS qx, y.q AS qy, x.ins AS i, y.ins AS j, x.insq AS iq, y.insq AS jq, coalesce(x.more, FALSE) AS xmore, coalesce(y.more, FALSE) AS ymore, substring('{views.REFERENCE}', CAST(g.r + 1 AS BIGINT), 1) AS f
   FROM g LEFT JOIN k x ON x.mol = g.mol AND x.r = g.r AND x.slot = 1 LEFT JOIN k y ON y.mol = g.mol AND y.r = g.r AND y.slot = 2),
 n AS (SELECT *, CASE WHEN x <> y THEN CASE WHEN x = f THEN 1 WHEN y = f THEN 2 WHEN y = '-' THEN 1 WHEN x = '-' THEN 2 WHEN {ACGT.format('x')} AND NOT {ACGT.format('y')} THEN 1 WHEN {ACGT.format('y')} AND NOT {ACGT.format('x')} THEN 2
    WHEN ascii(qx) > ascii(qy) + 4 THEN 1 WHEN ascii(qy) > ascii(qx) + 4 THEN 2 ELSE 0 END WHEN x IS NOT NULL AND y IS NOT NULL THEN 3 WHEN x IS NOT NULL THEN 1 WHEN y IS NOT NULL THEN 2 END AS way,
   CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN CASE WHEN i = j OR contains(j, i) THEN i WHEN contains(i, j) THEN j END WHEN i IS NOT NULL AND NOT (y IS NOT NULL AND ymore) THEN i WHEN j IS NOT NULL AND NOT (x IS NOT NULL AND xmore) THEN j END AS piece,
   CASE WHEN i = j THEN array_to_string(list_transform(range(1, length(i) + 1), lambda t: greatest(substring(iq, t, 1), substring(jq, t, 1))), '') WHEN i IS NOT NULL AND j IS NOT NULL THEN CASE WHEN contains(j, i) THEN iq WHEN contains(i, j) THEN jq END ELSE coalesce(iq, jq) END AS pieceq FROM m),
 o AS (SELECT mol, r, CASE WHEN x <> y THEN 'M' WHEN way IS NULL THEN 'N' WHEN coalesce(x, y) = '-' THEN 'D' ELSE 'M' END || CASE WHEN piece IS NULL THEN '' ELSE repeat('I', length(piece)) END AS ops,
   CASE way WHEN 0 THEN 'N' WHEN 1 THEN replace(x, '-', '') WHEN 2 THEN replace(y, '-', '') WHEN 3 THEN replace(x, '-', '') ELSE '' END || coalesce(lower(piece), '') AS s,
   CASE way WHEN 0 THEN chr(CAST((ascii(qx) + ascii(qy)) // 2 AS INT)) WHEN 1 THEN CASE x WHEN '-' THEN '' ELSE qx END WHEN 2 THEN CASE y WHEN '-' THEN '' ELSE qy END WHEN 3 THEN CASE x WHEN '-' THEN '' ELSE greatest(qx, qy) END ELSE '' END || CASE WHEN piece IS NULL THEN '' ELSE pieceq END AS q FROM n),
 z AS (SELECT mol, string_agg(ops, '' ORDER BY r) AS ops, string_agg(s, '' ORDER BY r) AS seq, string_agg(q, '' ORDER BY r) AS qual FROM o GROUP BY mol),
 l AS (SELECT mol, i, substring(ops, CAST(i AS BIGINT), 1) AS op FROM (SELECT mol, ops, unnest(range(1, length(ops) + 1)) AS i FROM z)),
 d AS (SELECT mol, op, count(*) AS n, min(i) AS i FROM (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY i) - row_number() OVER (PARTITION BY mol, op ORDER BY i) AS run FROM l) GROUP BY mol, op, run),
 y AS (SELECT mol, string_agg(n || op, '' ORDER BY i) AS cigar FROM d GROUP BY mol)
SELECT h.ord, split_part(h.qname, ' ', 1) || ' 3' || substring(split_part(h.qname, ' ', 2), strpos(split_part(h.qname, ' ', 2), ':')) AS qname, CAST(0 AS INT) AS flag, h.rname, CAST(h.s + 1 AS INT) AS pos, CAST(h.mapq AS INT) AS mapq,
  CASE WHEN front > 0 THEN front || 'H' ELSE '' END || y.cigar || CASE WHEN back > 0 THEN back || 'H' ELSE '' END AS cigar, z.seq, z.qual FROM h JOIN z USING (mol) JOIN y USING (mol)
UNION ALL SELECT ord, qname, flag, rname, pos, mapq, cigar, seq, qual FROM c WHERE mol NOT IN (SELECT mol FROM p)
"""


@register("sam_merge_records", RECORDS_SQL)
def sam_merge_records(spark: SparkSession, d: str) -> DataFrame:
    return sam_merge.merge_sam(aligned(spark, d), views.RNAME, views.REFERENCE)[0]


LONG_FORM = "array_to_string(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: repeat(right(x, 1), CAST(left(x, length(x) - 1) AS INT))), '')"


@register("cigar_round_trip", f"SELECT cigar, {LONG_FORM} AS long_form, cigar AS again, count(*) AS n FROM ({views.SAM_SQL}) GROUP BY ALL")
def cigar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    long_form = cigar.expanded(F.col("cigar"))
    return aligned(spark, d).groupBy("cigar").agg(F.count(F.lit(1)).alias("n")).select("cigar", long_form.alias("long_form"), cigar.condensed(long_form).alias("again"), "n")


@register("phase_labels", f"""WITH RECURSIVE t AS ({views.TAGS_SQL}), e AS (SELECT row, col FROM ({views.EDGES_SQL}) WHERE dist <= 0.2),
 u AS (SELECT row AS a, col AS b FROM e UNION SELECT col, row FROM e), g(a, b) AS (SELECT row, row FROM t UNION SELECT g.a, u.b FROM g JOIN u ON g.b = u.a),
 l AS (SELECT a AS row, min(b) AS root FROM g GROUP BY a), s AS (SELECT root, count(*) AS n, min(position) AS p, min(allele) AS m FROM l JOIN t USING (row) GROUP BY root),
 o AS (SELECT root, row_number() OVER (ORDER BY n DESC, p, m, root) AS phase FROM s)
 SELECT t.row, t.position, t.allele, o.phase FROM t JOIN l USING (row) JOIN o USING (root)""")
def phase_labels(spark: SparkSession, d: str) -> DataFrame:
    return phase.phases(views.tags(spark, d), views.edges(spark, d), 0.2)


SCORING = align.simple(2, 3, gap_open=4, gap_extend=1)


def few_reads(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d)


@register("align_all_scores")
def align_all_scores(spark: SparkSession, d: str) -> DataFrame:
    return align.align(few_reads(spark, d), views.references(spark, d), SCORING).select("ord", "ref_ord", "score", "ref_start", "cigar")


@register("align_best")
def align_best(spark: SparkSession, d: str) -> DataFrame:
    return align.sam_rows(align.align(few_reads(spark, d), views.references(spark, d), SCORING, rev_comp=True, best_match=True))


@register("align_three_pass", f"SELECT r.ord, CAST(0 AS INT) AS ref_ord, CAST(2 * length(r.sequence) AS BIGINT) AS score, CAST(strpos(g.ref, r.sequence) - 1 AS INT) AS ref_start, length(r.sequence) || 'M' AS cigar FROM ({views.PIECES_SQL}) r, ({views.LONG_REF_SQL}) g")
def align_three_pass(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of one long reference, made of all suppliers' references end to end, found again by three sweeps."""
    return align.align(views.pieces(spark, d), views.long_reference(spark, d), SCORING, method="3pass").select("ord", "ref_ord", "score", "ref_start", "cigar")


# Scores for the second engine: both gap tables and the best scores of a query letter at a time, a list over the reference.
CELLS = f"""
WITH RECURSIVE q AS ({views.TAGS_READ_SQL}), r AS ({views.SHORT_REFS_SQL}),
w(ord, ref_ord, s, ref, i, best, down, top) AS (
 SELECT q.ord, r.ref_ord, q.sequence, r.ref, 0, list_transform(range(0, length(r.ref) + 1), lambda j: CAST(0 AS BIGINT)), list_transform(range(0, length(r.ref) + 1), lambda j: CAST(-100000 AS BIGINT)), CAST(0 AS BIGINT) FROM q, r
 UNION ALL
 SELECT ord, ref_ord, s, ref, i + 1, now, nextdown, greatest(top, list_max(now)) FROM (
  SELECT *, list_transform(range(1, length(ref) + 2), lambda j: greatest(line[j], CASE WHEN j > 1 THEN list_max(list_transform(range(1, j), lambda k: line[k] - {{open}} - {{extend}} * (j - k - 1))) ELSE -100000 END)) AS now FROM (
   SELECT *, list_transform(range(1, length(ref) + 2), lambda j: greatest(0, CASE WHEN j = 1 THEN 0 ELSE greatest(nextdown[j], best[j - 1] + CASE WHEN substring(s, i + 1, 1) = substring(ref, j - 1, 1) THEN {{match}} ELSE -{{mismatch}} END) END)) AS line FROM (
    SELECT *, list_transform(range(1, length(ref) + 2), lambda j: greatest(best[j] - {{open}}, down[j] - {{extend}})) AS nextdown FROM w WHERE i < length(s))))
), a AS (SELECT ord, ref_ord, max(top) AS score FROM w GROUP BY ord, ref_ord)
"""
LARGE = align.simple(60, 50, gap_open=70, gap_extend=20)


@register("align_short_scores", CELLS.format(match=2, mismatch=3, open=4, extend=1) + "SELECT ord, ref_ord, nullif(score, 0) AS score FROM a")
def align_short_scores(spark: SparkSession, d: str) -> DataFrame:
    """Short tags of all customers against short references, gaps and all."""
    return align.align(views.tag_reads(spark, d), views.short_references(spark, d), SCORING, method="scores").select("ord", "ref_ord", "score")


@register("align_short_best", CELLS.format(match=2, mismatch=3, open=4, extend=1) + "SELECT ord, max_by(ref_ord, score * 1000 + ref_ord) AS ref_ord, nullif(max(score), 0) AS score FROM a GROUP BY ord")
def align_short_best(spark: SparkSession, d: str) -> DataFrame:
    """The best reference of each tag, by whole alignments."""
    return align.align(views.tag_reads(spark, d), views.short_references(spark, d), SCORING, best_match=True).select("ord", "ref_ord", "score")


@register("align_short_tallies", CELLS.format(match=60, mismatch=50, open=70, extend=20) + f"SELECT (SELECT count(*) FROM q) AS queries, (SELECT {SUM.format('length(sequence) <= 300')} FROM q) AS queries_at_most_300, (SELECT count(*) FROM r) AS \"references\", (SELECT length(ref) FROM r ORDER BY ref_ord LIMIT 1) AS first_reference_length, count(*) AS alignments, {SUM.format(f'score <= {align.FITTING}')} AS scores_fitting FROM a")
def align_short_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Tallies where part of the scores don't fit."""
    queries, references = views.tag_reads(spark, d), views.short_references(spark, d)
    return align.tallies(queries, references, align.align(queries, references, LARGE, method="scores"))


@register("align_tallies", f"SELECT count(*) AS queries, {SUM.format('length(sequence) <= 300')} AS queries_at_most_300, (SELECT count(*) FROM region) AS \"references\", (SELECT length(ref) FROM ({views.REFS_SQL}) ORDER BY ref_ord LIMIT 1) AS first_reference_length, count(*) * (SELECT count(*) FROM region) AS alignments, count(*) * (SELECT count(*) FROM region) AS scores_fitting FROM ({views.READS_SQL})")
def align_tallies(spark: SparkSession, d: str) -> DataFrame:
    queries, references = few_reads(spark, d), views.references(spark, d)
    return align.tallies(queries, references, align.align(queries, references, SCORING, method="scores"))


@register("sam_header", f"SELECT CAST(0 AS BIGINT) AS row, '@HD' || chr(9) || 'VN:1.4' AS line UNION ALL SELECT CAST(ref_ord + 1 AS BIGINT), '@SQ' || chr(9) || 'SN:' || split_part(name, ' ', 1) || chr(9) || 'LN:' || length(ref) FROM ({views.REFS_SQL})")
def sam_header(spark: SparkSession, d: str) -> DataFrame:
    return align.sam_header(views.references(spark, d))


@register("trim_stateless", Steps().polyg(3, 3).hard(2, 2).sql(f"ord, {VIEW} AS sequence", "WHERE hi - lo >= 20"))
def trim_stateless(spark: SparkSession, d: str) -> DataFrame:
    """What the streaming form of the trimmer gives, over a batch."""
    return trim_stream(views.reads(spark, d), clipping(polyg_trim=3, hard_trim=2), min_length=20).select("ord", "sequence")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
