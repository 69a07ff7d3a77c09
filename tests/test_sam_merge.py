import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.operators import sam_merge

REF = "CATGGATCCTTAGCAACGTG"
FIELDS = "ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
#: reference, mates (pos, cigar, seq, qual), merged (pos, cigar, seq, qual), observations, variant errors
VECTORS = [
    (REF, (3, "7M", "TGGATCC", "D" * 7), (8, "6M", "CCTTAG", "H" * 6), (3, "11M", "TGGATCCTTAG", "DDDDDHHHHHH"), 2, 0),
    (REF, (3, "7M", "TGGATCC", "D" * 7), (7, "6M", "TCATTA", "H" * 6), (3, "10M", "TGGATCCTTA", "DDDDHHDHHH"), 3, 1),  # the base of the reference wins
    (REF, (3, "7M", "TGGATCG", "D" * 7), (7, "6M", "TCATTA", "H" * 6), (3, "10M", "TGGATCNTTA", "DDDDHHFHHH"), 3, 1),  # neither is, and qualities are near
    (REF, (3, "7M", "TGGATCG", "D" * 7), (7, "6M", "TCATTA", "I" * 6), (3, "10M", "TGGATCATTA", "DDDDIIIIII"), 3, 1),  # the better quality wins
    (REF, (2, "5M", "ATGGA", "C" * 5), (10, "4M", "TTAG", "E" * 4), (2, "5M3N4M", "ATGGATTAG", "CCCCCEEEE"), 0, 0),
    (REF, (4, "2H6M", "GGATCC", "A" * 6), (6, "1H4M3S", "ATCCAAA", "B" * 7), (4, "2H6M3H", "GGATCC", "AABBBB"), 4, 0),
    (REF, (4, "2H6M1S", "GGATCCT", "A" * 7), (5, "2S3M4H", "CCGAG", "C" * 5), (4, "2H6M2H", "GGATCC", "ACCAAA"), 3, 1),
    (REF, (4, "4M2D3M", "GGATTTA", "A" * 7), (6, "6M", "ATCCTT", "B" * 6), (4, "9M", "GGATCCTTA", "AABBBBBBA"), 6, 2),  # a base goes before a gap
]


def pair(spark, first, second, name="m", flags=(0, 0)):
    rows = [(i, f"{name} {i + 1}:N", flags[i], "r", pos, 20 + i, c, s, q) for i, (pos, c, s, q) in enumerate((first, second))]
    return spark.createDataFrame(rows, FIELDS)


@pytest.mark.parametrize("reference, first, second, want, observations, errors", VECTORS)
def test_vectors(spark, reference, first, second, want, observations, errors):
    done, stats = sam_merge.merge_sam(pair(spark, first, second), "r", reference)
    row, counts = done.first(), stats.first()
    assert (row["pos"], row["cigar"], row["seq"], row["qual"]) == want
    assert (row["qname"], row["flag"], row["mapq"]) == ("m 3:N", 0, 20)
    assert (counts["observations"], counts["variant_errors"]) == (observations, errors)


def test_inserts(spark):
    reference = "ACGTACGTAC"
    base = ("4M2I4M", "ACGTGGACGT", "ABCDEFGHIJ")
    equal = pair(spark, (1, *base), (1, "4M2I4M", "ACGTGGACGT", "JJJJJAJJJJ"))
    row = sam_merge.merge_sam(equal, "r", reference)[0].first()
    assert (row["cigar"], row["seq"], row["qual"]) == ("4M2I4M", "ACGTggACGT", "JJJJJFJJJJ")
    contained = sam_merge.merge_sam(pair(spark, (1, *base), (1, "4M1I4M", "ACGTGACGT", "J" * 9)), "r", reference)
    assert contained[0].first()["seq"] == "ACGTgACGT"
    assert tuple(contained[1].first())[4:] == (1, 1)
    clash = sam_merge.merge_sam(pair(spark, (1, *base), (1, "4M1I4M", "ACGTCACGT", "J" * 9)), "r", reference)
    assert clash[0].first()["cigar"] == "8M"
    lone = sam_merge.merge_sam(pair(spark, (1, *base), (1, "8M", "ACGTACGT", "J" * 8)), "r", reference)
    assert lone[0].first()["cigar"] == "8M" and tuple(lone[1].first())[4:] == (1, 1)
    unmated = sam_merge.merge_sam(pair(spark, (1, *base), (7, "4M", "GTAC", "J" * 4)), "r", reference)
    assert unmated[0].first()["seq"] == "ACGTggACGTAC" and tuple(unmated[1].first())[4:] == (0, 0)


def test_slots_unmapped_and_qualities(spark):
    m = ("8M", "GATCCTTA", "F" * 8)
    rows = [(i, q, f, r, 5, 9, *x) for i, (q, f, r, x) in enumerate([
        ("a 1:N", 0, "r", m), ("a 2:N", 0, "r", m), ("a 2:N", 0, "r", m), ("b", 0, "r", m), ("b", 0, "r", m), ("c 2:N", 0, "r", m), ("d 1:N", 0, "other", m),
        ("e 1:N", 0, "r", m), ("e 2:N", 0, "r", ("8M", "GATCCTTA", "*")), ("f 1:N", 4, "r", m), ("f 2:N", 0, "r", m), ("g 1:N", 4, "r", m), ("g 2:N", 4, "r", m),
    ])]
    sam = spark.createDataFrame(rows, FIELDS)
    assert {r["mol"]: r["dropped"] for r in sam_merge.pair_up(sam, "r").collect()}["a"] == 1
    done, stats = sam_merge.merge_sam(sam, "r", REF)
    names = sorted(r["qname"] for r in done.collect())
    assert names == ["a 3:N", "b", "c 2:N", "e 1:N", "e 2:N", "f 3:N", "g 3:N"]
    assert stats.first()["observations"] == 16
    assert [r["metric"] for r in sam_merge.stats_rows(stats, "r").orderBy("row").collect()] == ["obs", "tmv", "fmv", "dmv", "insObs", "insErr"]


def test_cigar_round_trip(spark):
    texts = ["7S21M3D1I4N6M5H2P", "", "2M1D3M", "301M", "6=2X1I5D12M"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = df.select(cigar.expanded(F.col("c")).alias("e")).select("e", cigar.condensed(F.col("e")).alias("c")).collect()
    assert [r["c"] for r in got] == texts
    assert got[2]["e"] == "MMDMMM"


def test_molecules_are_read_and_sorted_once(spark):
    """Merged pairs, single reads and pairs without qualities (a missing one too) come of one reading."""
    rows = [
        (1, "M:1:F:1:2:3:5 1:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "JJJJ"), (2, "M:1:F:1:2:3:5 2:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "JJJJ"), (3, "M:1:F:1:2:3:5 2:N:0:A", 0, "r", 1, 20, "4M", "TTTT", "JJJJ"),
        (4, "M:1:F:1:2:4:5 2:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "JJJJ"),
        (5, "M:1:F:1:2:5:5 1:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "*"), (6, "M:1:F:1:2:5:5 2:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "JJJJ"),
        (7, "M:1:F:1:2:6:5 1:N:0:A", 0, "r", 1, 20, "4M", "ACGT", "JJJJ"), (8, "M:1:F:1:2:6:5 2:N:0:A", 0, "r", 1, 20, "4M", "ACGT", None),
    ]
    sam = spark.createDataFrame(rows, "ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    done, stats = sam_merge.merge_sam(sam, "r", "ACGT")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1
    found = {r["ord"]: r for r in done.collect()}
    assert sorted(found) == [1, 4, 5, 6, 7, 8] and found[1]["qname"] == "M:1:F:1:2:3:5 3:N:0:A" and found[8]["qual"] is None and found[4]["qname"] == rows[3][1]
    assert stats.first()["observations"] == 4
