import pytest

from readloom import cli

READ = "@m{0} {1}:N\n{2}\n+\n{3}\n"


def lines(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def fastq(path, side, sequences):
    path.write_text("".join(READ.format(i, side, s, "I" * len(s)) for i, s in enumerate(sequences)))
    return str(path)


@pytest.fixture
def pair(tmp_path):
    return fastq(tmp_path / "r1.fq", 1, ["GGGGACGT", "ACGTACGT", "GGGG"]), fastq(tmp_path / "r2.fq", 2, ["TTTTCCCC", "TT", "AACC"])


def test_trimmer(spark, tmp_path, pair, capsys):
    cli.main(["trimmer", *pair, "-o", str(tmp_path / "a"), "-2", str(tmp_path / "b"), "-G", "3", "-f", "-n", "3", "-v"], spark)
    assert lines(spark, tmp_path / "a")[1] == "ACGT" and lines(spark, tmp_path / "b")[1] == "TTTTCCCC"
    assert "Widow filtered:               2 reads (33.33%)" in capsys.readouterr().err
    with pytest.raises(ValueError):
        cli.main(["trimmer", pair[0], "-o", pair[0]], spark)


def test_xleave_and_sampler(spark, tmp_path, pair):
    cli.main(["xleave", *pair, "-o", str(tmp_path / "both")], spark)
    assert lines(spark, tmp_path / "both")[0::4] == ["@m0 1:N", "@m0 2:N", "@m1 1:N", "@m1 2:N", "@m2 1:N", "@m2 2:N"]
    cli.main(["xleave", str(tmp_path / "both"), "-o", str(tmp_path / "x"), "-2", str(tmp_path / "y")], spark)
    assert lines(spark, tmp_path / "y") == open(pair[1]).read().splitlines()
    cli.main(["sampler", *pair, "-o", str(tmp_path / "s"), "-2", str(tmp_path / "t"), "-t", "2"], spark)
    names = [[x.split()[0] for x in lines(spark, tmp_path / n)[0::4]] for n in "st"]
    assert names[0] == names[1] and len(names[0]) == 2
    with pytest.raises(SystemExit):
        cli.main(["sampler", pair[0], "-t", "1", "-p", "2"], spark)


def test_aligner(spark, tmp_path, capsys):
    (tmp_path / "ref.fa").write_text(">r1 x\nGACTCAGTAAGACACGGTCTAGCTGACTGT\n")
    (tmp_path / "q.fa").write_text(">q1\nAGTAACACGGTC\n>q2\nGTCTAGGTGACTA\n")
    cli.main(["aligner", str(tmp_path / "ref.fa"), str(tmp_path / "q.fa"), "-m", "1", "-x", "1", "-o", "2", "-e", "1", "--header", "--tally-diagnostics", str(tmp_path / "t")], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["@HD\tVN:1.4", "@SQ\tSN:r1\tLN:30"]
    assert out[2].split("\t")[:6] == ["q1", "0", "r1", "6", "255", "5M2D7M"] and out[3].split("\t")[3:6] == ["17", "255", "12M1S"]
    assert lines(spark, tmp_path / "t")[0] == "Number of queries: 2"


def test_preprocess_and_xflate(spark, tmp_path, capsys):
    reads = fastq(tmp_path / "r.fq", 1, ["GGGGACGT", "ACGT", "TTT", "ACGT"])
    cli.main(["preprocess", str(tmp_path / "t.xfl"), reads, "-G", "3", "-n", "4", "-L", str(tmp_path / "log")], spark)
    assert capsys.readouterr().out.splitlines() == [">C0%3", "ACGT"]
    assert "READ_PATTERN_COUNT_PASSING\t1" in lines(spark, tmp_path / "log")
    (tmp_path / "s.fa").write_text(">C0%3\nACGT\n")
    cli.main(["xflate", str(tmp_path / "t.xfl"), str(tmp_path / "s.fa"), "-i"], spark)
    assert capsys.readouterr().out.splitlines()[0::4] == ["@m0 1:N", "@m1 1:N", "@m3 1:N"]


def test_merge_sam_and_phase(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">r\nTTTTAAAAAGGCGGTTTT\n")
    row = "m {0}:N\t0\tr\t{1}\t9\t8M\t*\t0\t0\t{2}\tFFFFFFFF\n"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.4\n" + row.format(1, 5, "AAAAAGGC") + row.format(2, 11, "GCGGTTTT"))
    cli.main(["merge-sam", str(tmp_path / "ref.fa"), str(tmp_path / "a.sam"), str(tmp_path / "out"), "-S"], spark)
    assert lines(spark, tmp_path / "out.sam") == ["@HD\tVN:1.4", "m 3:N\t0\tr\t5\t9\t14M\t*\t0\t0\tAAAAAGGCGGTTTT\t" + "F" * 14]
    assert lines(spark, tmp_path / "out.stats")[0] == "r\tobs\t2"
    (tmp_path / "v.txt").write_text("R\tPosition\tC\tD\tMinority_Allele\nr\t10\tx\ty\tA\nr\t20\tx\ty\tC\n")
    (tmp_path / "m.sqm").write_text("10A\t0\t0.5\n20C\t0.5\t0\n")
    cli.main(["phase", str(tmp_path / "v.txt"), str(tmp_path / "m.sqm"), str(tmp_path / "p"), "-t", "0.4"], spark)
    assert [x.split("\t")[-1] for x in lines(spark, tmp_path / "p")] == ["Phase", "1", "2"]


def test_num_procs(capsys, monkeypatch):
    monkeypatch.setenv("LOCAL_PROCS_OVERRIDE", "5")
    cli.main(["num-procs", "-L", "-H"])
    assert capsys.readouterr().out == "5 2\n"


def run_stdin(monkeypatch, data, arguments, spark):
    import io
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(data)))
    cli.main(arguments, spark)


def test_standard_input_and_pipes(spark, tmp_path, pair, monkeypatch):
    import gzip
    import os
    import threading

    data = open(pair[0], "rb").read()
    cli.main(["trimmer", pair[0], "-o", str(tmp_path / "file"), "-G", "3"], spark)
    for i, sent in enumerate((data, gzip.compress(data[:9]) + gzip.compress(data[9:]))):
        run_stdin(monkeypatch, sent, ["trimmer", "-", "-o", str(tmp_path / f"in{i}"), "-G", "3"], spark)
        assert lines(spark, tmp_path / f"in{i}") == lines(spark, tmp_path / "file")
    fifo = str(tmp_path / "pipe")
    os.mkfifo(fifo)
    writer = threading.Thread(target=lambda: open(fifo, "wb").write(data))
    writer.start()
    cli.main(["trimmer", fifo, pair[1], "-o", str(tmp_path / "x"), "-2", str(tmp_path / "y")], spark)
    writer.join()
    assert lines(spark, tmp_path / "x") == data.decode().splitlines() and lines(spark, tmp_path / "y")[1] == "TTTTCCCC"
    assert not [f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("spool-")]


def test_sampling_of_unknown_numbers(spark, tmp_path, pair, monkeypatch, capsys):
    data = "".join(READ.format(i, 1, "ACGT", "IIII") for i in range(200)).encode()
    run_stdin(monkeypatch, data, ["sampler", "-", "-o", str(tmp_path / "a"), "-t", "30", "-v"], spark)
    assert "Downsampled 200 records to 30 (15.00 %)" in capsys.readouterr().err and len(lines(spark, tmp_path / "a")) == 120
    run_stdin(monkeypatch, data, ["sampler", "-", "-o", str(tmp_path / "b"), "-p", "50", "-s", "3"], spark)
    kept = [x for x in lines(spark, tmp_path / "b")[0::4]]
    assert 60 < len(kept) < 140 and kept == sorted(kept, key=lambda x: int(x[2:].split()[0]))
    run_stdin(monkeypatch, data, ["sampler", "-", "-o", str(tmp_path / "c"), "-p", "100"], spark)
    assert len(lines(spark, tmp_path / "c")) == 800


def test_one_file(spark, tmp_path, capsys):
    import gzip

    text = "".join(READ.format(i, 1, "GGGG" + "ACGT" * (i % 5), "I" * (4 + 4 * (i % 5))) for i in range(2000))
    (tmp_path / "r.fq").write_text(text)
    from readloom.sources import ranges

    old, ranges.RANGE_BYTES = ranges.RANGE_BYTES, 9000
    try:
        cli.main(["trimmer", str(tmp_path / "r.fq"), "-o", str(tmp_path / "o.fq.gz"), "-n", "1", "--one-file", "-v"], spark)
        cli.main(["trimmer", str(tmp_path / "r.fq"), "-o", str(tmp_path / "o.fq"), "-G", "3", "-n", "5", "--one-file"], spark)
    finally:
        ranges.RANGE_BYTES = old
    assert "Input:                     2000 reads" in capsys.readouterr().err
    raw = (tmp_path / "o.fq.gz").read_bytes()
    assert gzip.decompress(raw).decode() == text and raw.count(b"\x1f\x8b\x08") > 5
    assert (tmp_path / "o.fq").read_text().count("@") == 1200
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["o.fq", "o.fq.gz", "r.fq"]
    cli.main(["trimmer", str(tmp_path / "r.fq"), "-o", str(tmp_path / "o.fq"), "-G", "3", "-n", "9", "--one-file"], spark)
    assert (tmp_path / "o.fq").read_text().count("@") == 800


def test_counts_of_two_files_come_with_their_reads(spark, tmp_path, pair, capsys):
    cli.main(["trimmer", *pair, "-o", str(tmp_path / "a"), "-2", str(tmp_path / "b"), "-G", "3", "-n", "3", "-v"], spark)
    assert lines(spark, tmp_path / "a")[1::4] == ["ACGT", "ACGTACGT"] and lines(spark, tmp_path / "b")[1::4] == ["TTTTCCCC", "AACC"]
    said = capsys.readouterr().err
    assert "Input:                        6 reads" in said and "Length filtered:              2 reads" in said and "PolyG trimmed:                2 reads" in said
    from readloom.operators import trimmer
    from readloom.operators.trim import clipping
    from readloom.sources import fastx

    done = trimmer.trimmer(fastx.scan_paired(spark, *pair, dense=False), clipping(polyg_trim=3), 2, min_length=3)
    for out in done.outputs:
        out.collect()
    assert done.told() == done.counts.first().asDict()


def test_phase_in_place_and_a_failure(spark, tmp_path):
    table = "R\tPosition\tC\tD\tMinority_Allele\nr\t10\tx\ty\tA\nr\t20\tx\ty\tC\n"
    (tmp_path / "v.txt").write_text(table)
    (tmp_path / "m.sqm").write_text("10A\t0\t0.5\n30C\t0.5\t0\n")
    with pytest.raises(Exception, match="no phase"):
        cli.main(["phase", str(tmp_path / "v.txt"), str(tmp_path / "m.sqm")], spark)
    assert (tmp_path / "v.txt").read_text() == table and len(list(tmp_path.glob("*.parts*"))) == 0
    (tmp_path / "m.sqm").write_text("10A\t0\t0.5\n20C\t0.5\t0\n")
    cli.main(["phase", str(tmp_path / "v.txt"), str(tmp_path / "m.sqm"), "-t", "0.4"], spark)
    assert [x.split("\t")[-1] for x in (tmp_path / "v.txt").read_text().splitlines()] == ["Phase", "1", "2"]


def test_proteins_and_methods(spark, tmp_path, capsys):
    (tmp_path / "ref.fa").write_text(">r\nARARRA\n")
    (tmp_path / "q.fa").write_text(">q\nARRA\n")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "BLOSUM62.txt").write_text("# two letters of one\n   A  R\nA  4 -1\nR -1  5\n")
    for more in (["--alphabet", "aa"], ["--matrix", "blosum62", "--method", "3pass"], ["--matrix", str(tmp_path / "m" / "BLOSUM62.txt")]):
        cli.main(["aligner", str(tmp_path / "ref.fa"), str(tmp_path / "q.fa"), "--matrix-folder", str(tmp_path / "m"), *more], spark)
        assert capsys.readouterr().out.split("\t")[2:6] == ["r", "3", "255", "4M"]
    with pytest.raises(ValueError, match="no matrix pam30"):
        cli.main(["aligner", str(tmp_path / "ref.fa"), str(tmp_path / "q.fa"), "--matrix", "pam30"], spark)
