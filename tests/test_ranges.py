"""The range reader over every size of range, of plain files and of gzip files of many members."""

import gzip
import random

import pytest

from readloom.sources import ranges

RECORDS = [(f"r{i} 1:N@x", "ACGT" * (i % 4), ("@+@I" * (i % 4))) for i in range(23)]
TEXT = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{q}\n" for i, (h, s, q) in enumerate(RECORDS))


def read(path, size, kind="fastq"):
    reader = ranges.RangeReader({"path": str(path), "kind": kind, "rangeBytes": str(size)})
    out = []
    for part in reader.partitions():
        rows = [tuple(r.values()) for batch in reader.read(part) for r in batch.to_pylist()]
        assert [r[:2] for r in rows] == [(part.part, n) for n in range(len(rows))]
        out += [r[2:] for r in rows]
    return out


@pytest.mark.parametrize("end, lead", [("\n", ""), ("\r\n", ""), ("\n", "\n \n"), ("", "")])
def test_every_size_of_range(tmp_path, end, lead):
    text = lead + (TEXT if end else TEXT.rstrip("\n")).replace("\n", end or "\n") + ("\n\n" if end == "\n" else "")
    path = tmp_path / "a.fq"
    path.write_bytes(text.encode())
    for size in range(1, len(text) + 2, 1 if len(text) < 900 else 3):
        assert read(path, size) == RECORDS


def gzipped(text, cuts, level=6):
    cuts = [0, *cuts, len(text)]
    return b"".join(gzip.compress(text[a:b].encode(), level) for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("level", [0, 6])
def test_gzip_members_cut_anywhere(tmp_path, level):
    draw = random.Random(4)
    path = tmp_path / "a.fq.gz"
    for cuts in ([], sorted(draw.sample(range(len(TEXT)), 9)), list(range(7, len(TEXT), 7))):
        path.write_bytes(gzipped(TEXT, cuts, level) + bytes(draw.choice([0, 5])))
        size = path.stat().st_size
        for each in {size, size // 2, size // 5, 97, 31}:
            assert read(path, each) == RECORDS
            assert [r[0] for r in read(path, each, "lines")] == TEXT.splitlines()
    held = [len(list(ranges.RangeReader({"path": str(path), "kind": "fastq", "rangeBytes": "400"}).read(p))) for p in ranges.RangeReader({"path": str(path), "kind": "fastq", "rangeBytes": "400"}).partitions()]
    assert sum(n > 0 for n in held) > 3


def test_magic_bytes_inside_a_member(tmp_path):
    """Stored blocks show the text's own bytes, which may look like a member, here one with a wrong checksum."""
    inner = bytearray(gzip.compress(b"x" * 50))
    inner[-6] ^= 1
    text = "@a\nAC\n+\nII\n@b\nGG\n+\nJJ\n"
    path = tmp_path / "b.fq.gz"
    path.write_bytes(gzip.compress(bytes(inner) + b"\n" + text.encode(), 0) + gzip.compress(text.encode()))
    for size in (10, 30, 60, 1000):
        assert [r[0] for r in read(path, size, "lines")][-8:] == text.splitlines()
    path.write_bytes(gzip.compress(text.encode())[:-3])
    with pytest.raises(EOFError):
        read(path, 1000)
    path.write_bytes(gzip.compress(text.encode()) + b"junk")
    with pytest.raises(ValueError, match="no gzip member"):
        read(path, 1000)


@pytest.mark.parametrize("text", ["@a\nAC\n+\nA\n", "@a\nAC\n+\n", "@a\nAC\nx\nAA\n", "@a\nA\n+\nA\nb\nA\n+\nA\n", "@a\nA\n+\nA\n\n@b\nA\n+\nA\n"])
def test_bad_records(tmp_path, text):
    path = tmp_path / "a.fq"
    path.write_text(text)
    for size in (1, 5, 1000):
        with pytest.raises(ValueError, match="bad FASTQ record"):
            read(path, size)


def test_as_a_data_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ba":
        (tmp_path / "in" / f"{name}.fq").write_text(TEXT)
    (tmp_path / "in" / "_SUCCESS").write_text("")
    df = ranges.ranges(spark, str(tmp_path / "in"), "fastq", 300)
    assert df.rdd.getNumPartitions() == 6
    assert [tuple(r)[1:] for r in ranges.placed(df).orderBy("ord").collect()] == RECORDS * 2
    for most in (100, 0):
        ranges.BROADCAST_RANGES = most
        assert [r["ord"] for r in ranges.counted(df).orderBy("ord").collect()] == list(range(2 * len(RECORDS)))
    ranges.BROADCAST_RANGES = 100_000
    plan = ranges.placed(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
