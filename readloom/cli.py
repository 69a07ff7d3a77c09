"""The nine commands, as ``python -m readloom.cli COMMAND ...``; each reads files, runs one DataFrame plan, and writes files.

Outputs are folders of text parts in order (gzip if the path ends in .gz), one file each with --one-file, or standard output
if no path is given. ``-`` is standard input; pipes and devices are read too.
"""

from __future__ import annotations

import argparse
import os
import sys
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import runtime
from readloom.operators import align, dedup, pairing, phase, preprocess, sam_merge, sampling, trimmer
from readloom.operators.trim import Clipping, clipping
from readloom.sources import fastx, sam, sinks, spool, variants, xfl


def positive(value: str) -> int:
    if int(value) < 1:
        raise argparse.ArgumentTypeError("1 or more")
    return int(value)


def add_clipping(p: argparse.ArgumentParser) -> None:
    p.add_argument("-s", "--preserve-bases", "--preserve_fastq", action="store_true")
    p.add_argument("-G", "--polyg-trim", type=positive)
    p.add_argument("--g-polyg-end", default="b")
    p.add_argument("--g-polyg-left", type=positive)
    p.add_argument("--g-polyg-right", type=positive)
    p.add_argument("-B", "--barcode-trim")
    p.add_argument("--b-end", default="b")
    for name in ("--b-restrict", "--b-restrict-left", "--b-restrict-right", "--p-restrict-left", "--p-restrict-right"):
        p.add_argument(name, type=positive)
    p.add_argument("--b-hdist", type=int, default=0)
    p.add_argument("-A", "--adapter-trim")
    p.add_argument("--a-fuzzy", action="store_true")
    p.add_argument("-P", "--primer-trim")
    p.add_argument("--p-fuzzy", action="store_true")
    p.add_argument("--p-kmer-length", type=int)
    p.add_argument("--p-end", default="b")
    p.add_argument("--p-restrict", type=positive, default=30)
    p.add_argument("-H", "--hard-trim", type=int, default=0)
    p.add_argument("--h-left", type=int)
    p.add_argument("--h-right", type=int)


def clipping_of(spark: SparkSession, a: argparse.Namespace) -> Clipping:
    primers = None
    if a.primer_trim:  # a primer file is a few dozen short records
        primers = [r["sequence"] for r in fastx.scan_fasta(spark, a.primer_trim).select("sequence").collect()]
    return clipping(
        a.preserve_bases, a.polyg_trim, a.g_polyg_end, a.g_polyg_left, a.g_polyg_right, a.adapter_trim, a.a_fuzzy,
        a.barcode_trim, a.b_end, a.b_restrict, a.b_restrict_left, a.b_restrict_right, a.b_hdist,
        primers, a.p_fuzzy, a.p_kmer_length, a.p_end, a.p_restrict, a.p_restrict_left, a.p_restrict_right, a.hard_trim, a.h_left, a.h_right,
    )


def put(rows: DataFrame, path: str | None, order: str = "ord", one_file: bool = False, sort: bool = True) -> None:
    if path and one_file:
        sinks.write_file(rows, path, order, sort=sort)
    elif path:
        sinks.write_text(rows, path, order, sort=sort)
    else:
        sinks.print_text(rows, order)


def run_trimmer(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([a.input1, a.input2, a.primer_trim], [a.output, a.output2])
    options = clipping_of(spark, a)
    outputs = 2 if a.output2 else 1
    ordered = bool(a.input2) == bool(a.output2) and not a.filter_widows  # every output has its input's reads, in their order
    done = trimmer.trimmer(fastx.scan_paired(spark, a.input1, a.input2, dense=not ordered), options, outputs, a.filter_widows, a.mask, a.min_length)
    for reads, path in zip(done.outputs, (a.output, a.output2)):
        put(fastx.rendered(reads), path, one_file=a.one_file, sort=not ordered)
    if a.verbose:
        counts = done.told() if a.output else done.counts
        print(trimmer.report(counts, options, "two files" if a.input2 else "one file", a.mask, a.min_length, a.filter_widows, a.primer_trim), file=sys.stderr)


def run_sampler(spark: SparkSession, a: argparse.Namespace) -> None:
    """A known number of records is sampled exactly; of an unknown one, as of streams and gzip files, a share is drawn record by
    record and a number of records through a reservoir, both in one pass."""
    sinks.check_paths([a.input1, a.input2], [a.output, a.output2])
    if a.output2 and not a.output:
        raise SystemExit("--output2 goes with --output")
    if a.percent is not None:
        sampling.check_percent(a.percent)
    paired = bool(a.input2 or a.output2)
    inputs = fastx.scan_paired(spark, a.input1, a.input2, dense=paired)
    units = (pairing.zip_pairs(*inputs) if len(inputs) == 2 else pairing.deinterleave(inputs[0])) if paired else inputs[0]
    key = "pair_idx" if paired else "ord"
    before = None
    if any(p and p not in a.streams and spool.sized(p) for p in (a.input1, a.input2)):
        before = units.count()
        chosen = sampling.sample_exact(units, a.target if a.percent is None else before * a.percent // 100, key, seed=a.rng_seed)
        after = min(before, a.target if a.percent is None else before * a.percent // 100)
    elif a.percent is not None:
        chosen = sampling.sample_fraction(units, a.percent, key, seed=a.rng_seed)
    else:
        chosen, before = sampling.sample_reservoir(units, a.target, key, seed=a.rng_seed)
        after = min(before, a.target)
    if not paired:
        put(fastx.rendered(chosen), a.output, one_file=a.one_file)
    elif a.output2:
        put(fastx.rendered(pairing.mates(chosen, 1)), a.output, one_file=a.one_file)
        put(fastx.rendered(pairing.mates(chosen, 2)), a.output2, one_file=a.one_file)
    else:
        put(fastx.rendered(pairing.interleave(chosen)), a.output, one_file=a.one_file)
    if a.verbose:
        if before is None:
            before, after = units.count(), chosen.count()
        print(sampling.summary(before, after), file=sys.stderr)


def run_xleave(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([a.input1, a.input2], [a.output, a.output2])
    inputs = fastx.scan_paired(spark, a.input1, a.input2)
    if len(inputs) == 2 and not a.output2:
        put(fastx.rendered(pairing.interleave(pairing.zip_pairs(*inputs))), a.output, one_file=a.one_file)
    elif len(inputs) == 1 and a.output2:
        pairs = pairing.deinterleave(inputs[0])
        put(fastx.rendered(pairing.mates(pairs, 1)), a.output, one_file=a.one_file)
        put(fastx.rendered(pairing.mates(pairs, 2)), a.output2, one_file=a.one_file)
    else:
        raise SystemExit("two inputs and one output, or one input and two outputs")


def scoring_of(a: argparse.Namespace) -> align.Scoring:
    if a.matrix and (a.alphabet == "dna" or a.ignore_n or a.matching is not None or a.mismatch is not None):
        raise SystemExit("a matrix goes with the aa alphabet and without scores")
    if a.ignore_n and a.alphabet == "aa":
        raise SystemExit("--ignore-n goes with the dna alphabet")
    if a.matrix or a.alphabet == "aa" and a.matching is None and a.mismatch is None:
        return align.named(align.matrix_text(a.matrix or align.DEFAULT_MATRIX, a.matrix_folder), a.gap_open, a.gap_extend)
    return align.simple(a.matching, a.mismatch, a.alphabet or "dna", a.ignore_n, a.gap_open, a.gap_extend)


def run_aligner(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([a.ref_file, a.query_file], [a.output, a.tally_diagnostics])
    references, queries = fastx.references(fastx.scan(spark, a.ref_file)), fastx.scan(spark, a.query_file, dense=False)
    done = align.align(queries, references, scoring_of(a), a.rev_comp, a.best_match, a.method)
    rows = align.sam_rows(done, a.exclude_unmapped).select("ord", "ref_ord", F.col("line").alias("text"))
    rows = rows.select(F.struct("ord", "ref_ord").alias("place"), "text")
    if a.header:
        head = align.sam_header(references).select(F.struct(F.lit(-1).cast("long").alias("ord"), F.col("row").cast("int").alias("ref_ord")).alias("place"), F.col("line").alias("text"))
        rows = head.unionByName(rows)
    put(rows, a.output, "place", one_file=a.one_file)
    if a.tally_diagnostics:
        every = align.align(queries, references, scoring_of(a), a.rev_comp, method="scores")
        row = align.tallies(queries, references, every, a.rev_comp).first()
        labels = ["Number of queries", "Queries at most length 300", "Number of references", "Length of first reference", "Number of alignments performed", "Estimated number of alignments fitting i8"]
        lines = spark.createDataFrame([(i, f"{k}: {v}") for i, (k, v) in enumerate(zip(labels, row))], "ord int, text string")
        sinks.write_text(lines, a.tally_diagnostics, one_file=True)


def run_preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([a.input1, a.input2, a.primer_trim], [a.table_file, a.log_file])
    inputs = fastx.scan_paired(spark, a.input1, a.input2)
    stored, figures = preprocess.preprocess(inputs, clipping_of(spark, a), a.min_length, a.min_read_quality, a.use_median, a.enforce_clipped_length, a.filter_widows)
    clusters = dedup.deflate(stored)
    sinks.write_text(xfl.rendered(clusters), a.table_file, "cluster_id")
    sinks.print_text(xfl.rendered_sequences(clusters), "cluster_id")
    if a.log_file:
        log = preprocess.log(stored, figures, len(inputs), a.min_length, a.min_read_quality, a.use_median)
        sinks.write_text(log.select("row", F.concat("key", F.lit("\t"), "value").alias("text")), a.log_file, "row", one_file=True)
    if clusters.isEmpty():
        for line in preprocess.diagnosis(figures, len(inputs), a.min_length, a.min_read_quality):
            print(f"WARNING! {line}", file=sys.stderr)


def run_merge_sam(spark: SparkSession, a: argparse.Namespace) -> None:
    out, stats_path = f"{a.output_prefix}.sam", f"{a.output_prefix}.stats" if a.store_stats else None
    sinks.check_paths([a.fasta_reference, a.sam_file], [out, stats_path])
    name, reference = fastx.first_reference(fastx.scan_fasta(spark, a.fasta_reference))
    head, rows = sam.scan_sam(spark, a.sam_file)
    merged, stats = sam_merge.merge_sam(rows, name, reference, a.bowtie_format)
    lines = head.select(F.col("ord") - (1 << 60), F.col("line").alias("text")).toDF("ord", "text").unionByName(sam.rendered(merged))
    sinks.write_text(lines, out)
    if stats_path:
        text = sam_merge.stats_rows(stats, name).select("row", F.concat_ws("\t", "name", "metric", F.col("value").cast("string")).alias("text"))
        sinks.write_text(text, stats_path, "row", one_file=True)


def run_xflate(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([*a.seq_files, *([a.table_file] if a.inflate else [])], [] if a.inflate else [a.table_file])
    tables = [fastx.scan(spark, p, i) for i, p in enumerate(a.seq_files)]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    if a.inflate:
        names = every.select(F.struct("src", "ord").alias("ord"), F.col("header").alias("name"), "sequence")
        done = dedup.inflate(xfl.scan_xfl(spark, a.table_file), names)
        place = F.struct("cluster_id", "member").alias("ord")
        put(fastx.rendered(done.select(place, "header", "sequence", "quality")), None)
    else:
        clusters = dedup.deflate(every)
        sinks.write_text(xfl.rendered(clusters), a.table_file, "cluster_id")
        sinks.print_text(xfl.rendered_sequences(clusters), "cluster_id")


def run_phase(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.check_paths([a.variants_file, a.sqm_file], [a.output] if a.output else [])
    head, rows = variants.scan_variants(spark, a.variants_file)
    if rows.limit(2).count() < 2:  # the matrix is not read
        done = rows.withColumn("phase", F.lit(1))
    else:
        tags, edges = variants.scan_matrix(spark, a.sqm_file)
        done = phase.with_phase(rows, phase.phases(tags, edges, a.tree_height))
    if a.output:
        variants.write_phases(done, head, a.output)
    else:
        variants.rewrite_phases(done, head, a.variants_file)


def run_num_procs(_: object, a: argparse.Namespace) -> None:
    found = runtime.processors(a.physical, cap=a.cap_cores_using_env)
    print(f"{found} {max(1, found // 2)}" if a.include_half else found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str, inputs: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        if inputs:
            p.add_argument("input1")
            p.add_argument("input2", nargs="?")
        return p

    def outputs(p: argparse.ArgumentParser) -> None:
        p.add_argument("-1", "-o", "--output", "--output1")
        p.add_argument("-2", "--output2")
        p.add_argument("--one-file", action="store_true", help="one file instead of a folder of parts")

    p = command("trimmer", run_trimmer, inputs=True)
    outputs(p)
    p.add_argument("-m", "--mask", action="store_true")
    p.add_argument("-n", "--min-length", type=positive, default=1)
    p.add_argument("-f", "--filter-widows", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    add_clipping(p)
    p = command("sampler", run_sampler, inputs=True)
    outputs(p)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("-t", "--subsample-target", dest="target", type=int)
    which.add_argument("-p", "--percent-target", dest="percent", type=int)
    p.add_argument("-s", "--rng-seed", type=int, default=0)
    p.add_argument("-v", "--verbose", action="store_true")
    outputs(command("xleave", run_xleave, inputs=True))
    p = command("aligner", run_aligner, "ref_file", "query_file")
    p.add_argument("--output", "--out")
    p.add_argument("--one-file", action="store_true", help="one file instead of a folder of parts")
    for short, name, default in (("-m", "--matching", None), ("-x", "--mismatch", None), ("-o", "--gap-open", 10), ("-e", "--gap-extend", 1)):
        p.add_argument(short, name, type=int, choices=range(128), default=default, metavar="0..127")
    p.add_argument("-r", "--rev-comp", action="store_true")
    p.add_argument("--matrix", help="a published protein matrix: the path of its file, or its name in the matrix folder")
    p.add_argument("--matrix-folder", default=os.environ.get("READLOOM_MATRICES"), help="where matrix files lie, named as their matrices are")
    p.add_argument("--alphabet", choices=("dna", "aa"))
    p.add_argument("--tally-diagnostics")
    p.add_argument("--method", choices=("1pass", "3pass"), default="1pass", help="3pass takes memory by the lengths and not by their product")
    for name in ("--ignore-n", "--exclude-unmapped", "--best-match", "--header", "--profile-from-ref", "--profile-from-query", "--single-thread"):
        p.add_argument(name, action="store_true")
    p = command("preprocess", run_preprocess, "table_file", inputs=True)
    p.add_argument("-L", "--log-file")
    p.add_argument("-T", "--min-read-quality", type=int, default=0)
    p.add_argument("-M", "--use-median", action="store_true")
    p.add_argument("-n", "--min-length", type=positive, default=1)
    p.add_argument("-E", "--enforce-clipped-length", action="store_true")
    p.add_argument("-f", "--filter-widows", action="store_true")
    add_clipping(p)
    p = command("merge-sam", run_merge_sam, "fasta_reference", "sam_file", "output_prefix")
    p.add_argument("-S", "--store-stats", action="store_true")
    p.add_argument("-B", "--bowtie-format", action="store_true")
    p = command("xflate", run_xflate, "table_file")
    p.add_argument("seq_files", nargs="+")
    p.add_argument("-i", "--inflate", action="store_true")
    p = command("phase", run_phase, "variants_file", "sqm_file")
    p.add_argument("output", nargs="?", help="folder for the table with phases; without it the variants file is rewritten")
    p.add_argument("-t", "--tree-height", type=float, default=phase.HEIGHT)
    p = command("num-procs", run_num_procs)
    kind = p.add_mutually_exclusive_group(required=True)
    kind.add_argument("-P", "--physical", action="store_true")
    kind.add_argument("-L", "--logical", action="store_true")
    p.add_argument("-H", "--include-half", action="store_true")
    p.add_argument("-C", "--cap-cores-using-env", action="store_true")
    return top


#: Arguments that name inputs.
INPUTS = ("input1", "input2", "ref_file", "query_file", "fasta_reference", "sam_file", "seq_files", "sqm_file")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    if a.run is run_num_procs:
        return a.run(spark, a)
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    a.streams = set()
    with ExitStack() as spools:

        def readable(path: str) -> str:
            found = spools.enter_context(spool.spooled(spark, path))
            if found != path:
                a.streams.add(found)
            return found

        for name in INPUTS:
            value = getattr(a, name, None)
            if value and isinstance(value, list):
                setattr(a, name, [readable(v) for v in value])
            elif value:
                setattr(a, name, readable(value))
        a.run(spark, a)


if __name__ == "__main__":
    main()
