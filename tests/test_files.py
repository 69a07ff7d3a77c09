import gzip

import pytest
from pyspark.sql import functions as F

from readloom import runtime
from readloom.functions import bases
from readloom.operators import dedup, pairing, phase, sampling, trim, trimmer
from readloom.sources import fastx, sam, sinks, variants, xfl
from readloom.streaming import reads as streams

FASTQ = "@a 1:N\nACGT\n+\n@@@@\n@b 1:N\n\n+\n\n@c 1:N\nGGGG\n+x\n!!!!\n"


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_fastq(spark, tmp_path):
    got = [tuple(r) for r in fastx.scan(spark, put(tmp_path / "a.fq", FASTQ)).orderBy("ord").collect()]
    assert got == [(1, 0, "a 1:N", "ACGT", "@@@@"), (1, 1, "b 1:N", "", ""), (1, 2, "c 1:N", "GGGG", "!!!!")]
    assert fastx.scan(spark, put(tmp_path / "b.fq", "\n\n" + FASTQ + "\n")).count() == 3
    with open(tmp_path / "c.fq.gz", "wb") as f:
        f.write(gzip.compress(FASTQ.encode()) + gzip.compress(FASTQ.encode()))
    assert [r["ord"] for r in fastx.scan(spark, str(tmp_path / "c.fq.gz")).orderBy("ord").collect()] == list(range(6))


def test_fastq_over_many_splits(spark, tmp_path):
    text = "".join(f"@r{i} 1:N\n{'ACGT' * (i % 7)}\n+\n{'@+@I' * (i % 7)}\n" for i in range(3000))
    path = put(tmp_path / "a.fq", text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = fastx.scan_fastq(spark, path).orderBy("ord").collect()
        assert fastx.scan_fastq_lines(spark, path).orderBy("ord").collect() == rows  # as from a store that only Spark reads
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r["ord"], r["header"], len(r["quality"])) for r in rows] == [(i, f"r{i} 1:N", 4 * (i % 7)) for i in range(3000)]


@pytest.mark.parametrize("text", ["@a\nAC\n+\nA\n", "@a\nAC\n+\n", "@a\nAC\nx\nAA\n", "@a\nA\n+\nA\nb\nA\n+\nA\n"])
def test_bad_fastq(spark, tmp_path, text):
    with pytest.raises(Exception, match="bad FASTQ record"):
        fastx.scan_fastq(spark, put(tmp_path / "a.fq", text)).collect()


def test_fasta_and_sniffing(spark, tmp_path):
    path = put(tmp_path / "a.fa", "\n>x one\nAC\nGT\n>y\n\n>z >w\nA\r\nC\n")
    assert [tuple(r)[1:] for r in fastx.scan(spark, path).orderBy("ord").collect()] == [(0, "x one", "ACGT", None), (1, "y", "", None), (2, "z >w", "AC", None)]
    assert fastx.first_reference(fastx.scan(spark, path)) == ("x", "ACGT")
    for text in ("", "plain"):
        with pytest.raises(ValueError):
            fastx.sniff(spark, put(tmp_path / f"{len(text)}.fa", text))
    with pytest.raises(ValueError):
        fastx.scan_paired(spark, path, put(tmp_path / "q.fq", FASTQ))


def test_round_trip_through_files(spark, tmp_path):
    rows = fastx.scan(spark, put(tmp_path / "a.fq", FASTQ))
    for name in ("out", "out.gz"):
        sinks.write_text(fastx.rendered(rows), str(tmp_path / name), one_file=True)
        part = next(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        text = (gzip.open if name.endswith(".gz") else open)(part, "rt").read()
        assert text == FASTQ.replace("+x", "+")


def test_sam_file(spark, tmp_path):
    head, rows = sam.scan_sam(spark, put(tmp_path / "a.sam", "@HD\tVN:1.4\nq\t0\tr\t5\t9\t2M\t*\t0\t0\tAC\tII\tAS:i:4\n"))
    assert head.first()["line"].startswith("@HD")
    row = rows.first()
    assert (row["qname"], row["pos"], row["seq"], row["tags"]) == ("q", 5, "AC", ["AS:i:4"])
    assert sam.rendered(rows).first()["text"] == "q\t0\tr\t5\t9\t2M\t*\t0\t0\tAC\tII"
    with pytest.raises(Exception, match="short SAM row"):
        sam.scan_sam(spark, put(tmp_path / "b.sam", "q\t0\n"))[1].collect()


def test_clusters_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(1, i, f"h\t{i}", s, "I" * len(s)) for i, s in enumerate(["AC", "GG", "AC", "AC", "TTT"])], "src int, ord long, header string, sequence string, quality string")
    done = dedup.deflate(reads)
    assert [(r["cluster_id"], r["size"], r["sequence"]) for r in done.orderBy("cluster_id").collect()] == [(0, 3, "AC"), (1, 1, "GG"), (2, 1, "TTT")]
    sinks.write_text(xfl.rendered(done), str(tmp_path / "t"), "cluster_id")
    sinks.write_text(xfl.rendered_sequences(done), str(tmp_path / "s"), "cluster_id")
    back = dedup.inflate(xfl.scan_xfl(spark, str(tmp_path / "t")), xfl.scan_sequences(spark, str(tmp_path / "s")))
    assert sorted((r["header"], r["sequence"]) for r in back.collect()) == [("h 0", "AC"), ("h 1", "GG"), ("h 2", "AC"), ("h 3", "AC"), ("h 4", "TTT")]
    assert dedup.members(reads, dedup.clusters(reads)).where("cluster_id = 0").count() == 3


def test_inflate_rules(spark):
    table = spark.createDataFrame([(0, [("a", "I")]), (7, [("b", "J")]), (9, [("c", "K")])], "cluster_id long, members array<struct<header:string,quality:string>>")
    names = spark.createDataFrame([(0, "C0%1", "A"), (1, "C0%1", "C"), (2, "C7%1{c}", "ACR")], "ord long, name string, sequence string")
    assert {r["header"]: r["sequence"] for r in dedup.inflate(table, names).collect()} == {"a": "C", "b": "YGT"}
    with pytest.raises(Exception, match="no cluster name"):
        dedup.inflate(table, spark.createDataFrame([(0, "D0", "A")], "ord long, name string, sequence string")).collect()


def test_pairing_errors(spark):
    kind = "src int, ord long, header string, sequence string, quality string"
    a = spark.createDataFrame([(1, 0, "m 1:N", "A", "I"), (1, 1, "n 1:N", "A", "I")], kind)
    b = spark.createDataFrame([(2, 0, "m 2:N", "A", "I")], kind)
    with pytest.raises(pairing.PairingError, match="pair 1: extra first read: n"):
        pairing.check_pairs(pairing.zip_pairs(a, b, check=False))
    with pytest.raises(Exception, match="extra first read"):
        pairing.zip_pairs(a, b).collect()
    assert pairing.interleave(pairing.zip_pairs(a.limit(1), b)).count() == 2


def test_trim_edges(spark):
    kind = "src int, ord long, header string, sequence string, quality string"
    reads = spark.createDataFrame([(1, 0, "a", "", ""), (1, 1, "b", "GGGG", "IIII"), (1, 2, "c", "acgu-n", "ABCDEF"), (1, 3, "d", "GGACGTGG", "ABCDEFGH")], kind)
    got = {r["ord"]: (r["sequence"], r["quality"]) for r in trim.trim(reads, trim.clipping(polyg_trim=2)).collect()}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("ACGNNN", "ABCDEF"), 3: ("ACGT", "CDEF")}
    masked = {r["ord"]: r["sequence"] for r in trim.trim(reads, trim.clipping(polyg_trim=2, h_left=1), mask=True).collect()}
    assert masked == {0: "", 1: "NNNN", 2: "NCGNNN", 3: "NNNCGTNN"}
    kept = trimmer.trimmer([reads], trim.clipping(polyg_trim=2), min_length=5)
    assert [r["ord"] for r in kept.outputs[0].collect()] == [2]
    assert "with a PolyG threshold of 2 bases" in trimmer.report(kept.counts, trim.clipping(polyg_trim=2), "one file", min_length=5)


@pytest.mark.parametrize("bad", [{"adapter_trim": "A", "barcode_trim": "C"}, {"adapter_trim": " "}, {"barcode_trim": "AXC"}, {"b_hdist": 4}, {"primer_trim": ["ACG"]}, {"primer_trim": ["ACG"], "p_kmer_length": 22}, {"p_end": "x"}])
def test_clipping_options(bad):
    with pytest.raises(ValueError):
        trim.clipping(**bad)


def test_find_matches_plain_search(spark):
    rows = [("ACGTACGTTGCA",), ("TTTT",), ("",), ("ACG",), ("GGACCTNNACGA",)]
    df = spark.createDataFrame(rows, "s string")
    for pattern, d in (("ACGA", 0), ("ACGA", 1), ("ACGA", 2), ("ACGTACGTTGCAACGTACGT"[:12], 3), ("ACGTTGCATGCATGCATGCAA", 3)):
        n = len(pattern)
        want = [next((i + 1 for i in range(len(s) - n + 1) if sum(a != b for a, b in zip(s[i : i + n], pattern)) <= d), 0) for (s,) in rows]
        assert [r[0] for r in df.select(bases.find(F.col("s"), pattern, d)).collect()] == want


def test_sampling(spark):
    df = spark.range(5000).withColumnRenamed("id", "ord")
    for n in (0, 1, 777, 5000):
        assert sampling.sample_exact(df, n, "ord", seed=3).count() == n
    with pytest.warns(UserWarning):
        assert sampling.sample_exact(df, 5001, "ord").count() == 5000
    assert sampling.sample(df, "ord", percent=33).count() == 1650
    assert sorted(sampling.sample(df, "ord", target=9, seed=1).collect()) == sorted(sampling.sample(df.repartition(7), "ord", target=9, seed=1).collect())
    for bad in ({}, {"target": 1, "percent": 1}, {"percent": 101}):
        with pytest.raises(ValueError):
            sampling.sample(df, "ord", **bad)
    assert sampling.summary(177564, 35512) == "Downsampled 177564 records to 35512 (20.00 %)."
    assert sampling.summary(0, 0).endswith("(0.00 %).")


def test_variants_and_phases(spark, tmp_path):
    table = "Ref\tPosition\tC\tD\tMinority_Allele\nr\t10\tx\ty\tA\n\nr\t20\tx\ty\tC\nr\t30\tx\ty\tG\n"
    matrix = "10A\t0\t0.5\t0.9\n20C\t0.5\t0\t0.95\n30G\t0.9\t0.95\t0\n"
    head, rows = variants.scan_variants(spark, put(tmp_path / "v.txt", table))
    tags, edges = variants.scan_matrix(spark, put(tmp_path / "m.sqm", matrix))
    found = phase.phases(tags, edges)
    done = phase.with_phase(rows, found)
    assert {r["position"]: r["phase"] for r in done.collect()} == {10: 1, 20: 1, 30: 2}
    variants.write_phases(done, head, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert len(lines) == 4
    with pytest.raises(Exception, match="no phase"):
        phase.with_phase(rows, found.where("position < 30")).collect()
    for bad in ("Ref\tPos\tC\tD\tMinority_Allele\n", table.replace("Minority_Allele", "Minority_Allele\tPhase", 1)):
        with pytest.raises(ValueError):
            variants.scan_variants(spark, put(tmp_path / "bad.txt", bad))
    for bad in ("10A\t0\n20C\t0\n", "10A\t0\t1\n10A\t1\t0\n", "A\t0\n"):
        with pytest.raises(ValueError):
            variants.scan_matrix(spark, put(tmp_path / "bad.sqm", bad))
    assert [r["phase"] for r in phase.phases(tags.limit(1), edges).collect()] == [1]


def test_paths(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.check_paths([a, a, None], [b, "/dev/null", "/dev/null"])
    for read, written in (([a], [a]), ([], [b, b])):
        with pytest.raises(ValueError):
            sinks.check_paths(read, written)


def test_runtime(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = runtime.ranked(df, F.col("k").desc(), F.col("id")).orderBy("k", "id").collect()
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert {(r["id"]): r["rank"] for r in got} == {i: n for n, (_, i) in enumerate(want)}
    assert runtime.processors(env={"LOCAL_PROCS_OVERRIDE": "99"}) == 99
    assert runtime.processors(env={"NSLOTS": "1", "IFX_LOCAL_PROCS": "7"}) == 1
    assert runtime.processors(halved=True, env={"NSLOTS": "1"}) == 1


def test_stream(spark, tmp_path):
    reads = spark.createDataFrame([(1, i, "h", "GGG" + "ACGT" * i, "I" * (3 + 4 * i)) for i in range(4)], "src int, ord long, header string, sequence string, quality string")
    reads.write.parquet(str(tmp_path / "in"))
    flow = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    query = streams.write_stream(streams.trim_stream(flow, trim.clipping(polyg_trim=3), min_length=5), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r["sequence"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ACGT" * 2, "ACGT" * 3]
