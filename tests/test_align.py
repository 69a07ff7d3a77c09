import random

import pytest

from readloom.operators import align

REF = "GACTCAGTAAGACACGGTCTAGCTGACTGT"
DOCUMENTED = align.simple(1, 1, gap_open=2, gap_extend=1)


def test_documented_examples():
    assert align.local_alignment("AGTAACACGGTC", REF, DOCUMENTED) == (9, 5, "5M2D7M")
    assert align.local_alignment("GTCTAGGTGACTA", REF, DOCUMENTED) == (10, 16, "12M1S")


def brute(q, r, s):
    """Best local score by the plain three-table recurrence."""
    low = -(10**9)
    w = lambda a, b: s.weights[s.alphabet.index(a)][s.alphabet.index(b)]
    best = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    x, y, top = [[low] * (len(r) + 1) for _ in best], [[low] * (len(r) + 1) for _ in best], 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            x[i][j] = max(best[i - 1][j] - s.gap_open, x[i - 1][j] - s.gap_extend)
            y[i][j] = max(best[i][j - 1] - s.gap_open, y[i][j - 1] - s.gap_extend)
            best[i][j] = max(0, best[i - 1][j - 1] + w(q[i - 1], r[j - 1]), x[i][j], y[i][j])
            top = max(top, best[i][j])
    return top


def rescored(q, r, found, s):
    """Score of a traceback, operation by operation."""
    import re

    score, start, cigar = found
    i, j, total = 0, start, 0
    for n, op in re.findall(r"(\d+)([MIDS])", cigar):
        n = int(n)
        if op == "M":
            total += sum(s.weights[s.alphabet.index(a)][s.alphabet.index(b)] for a, b in zip(q[i : i + n], r[j : j + n]))
        elif op in "ID":
            total -= s.gap_open + s.gap_extend * (n - 1)
        i += n if op in "MIS" else 0
        j += n if op in "MD" else 0
    assert i == len(q)
    return total


@pytest.mark.parametrize("scoring", [DOCUMENTED, align.simple(), align.simple(3, 2, gap_open=3, gap_extend=3), align.simple(2, 1, ignore_n=True, gap_open=2, gap_extend=1)])
def test_against_recurrence(scoring):
    draw = random.Random(5)
    for _ in range(150):
        q, r = ("".join(draw.choice("ACGTN") for _ in range(draw.randrange(1, 14))) for _ in range(2))
        for method in ("1pass", "3pass"):
            found = align.local_alignment(q, r, scoring, method)
            assert (found[0] if found else 0) == brute(q, r, scoring)
            if found:
                assert rescored(q, r, found, scoring) == found[0]
        assert align.local_scores([q], [r], scoring) == [brute(q, r, scoring)]


def test_three_passes_over_long_references():
    """Gaps wider than the first band, many pairs at once, and the same scores and ends as one sweep gives."""
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    queries, references = [], []
    for _ in range(30):
        r = letters(draw.randrange(200, 900))
        a, b, c = sorted(draw.sample(range(len(r)), 3))
        q = r[a:b] + letters(draw.choice([0, 3, 60])) + r[draw.choice([b, c]) :]
        queries.append("".join(x if draw.random() > 0.05 else draw.choice("ACGT") for x in q))
        references.append(r)
    scoring = align.simple(2, 3, gap_open=4, gap_extend=1)
    one, three = (align.local_alignments(queries, references, scoring, m) for m in ("1pass", "3pass"))
    for q, r, x, y in zip(queries, references, one, three):
        assert x[0] == y[0] == rescored(q, r, y, scoring)
    assert any("D" in y[2] and max(int(n) for n, op in __import__("re").findall(r"(\d+)([ID])", y[2])) > align.BAND for y in three if "D" in y[2] or "I" in y[2])


def test_memory_of_three_passes_grows_with_the_lengths():
    import tracemalloc

    draw = random.Random(2)
    r = "".join(draw.choice("ACGT") for _ in range(20_000))
    q = r[3000:9000]
    tracemalloc.start()
    found = align.local_alignment(q, r, align.simple(), "3pass")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (12_000, 3000, "6000M") and most < 40 << 20  # one table of 6000 x 20,000 cells takes 480 MB


def test_scores_past_the_capacity_are_errors(monkeypatch):
    monkeypatch.setattr(align, "CAPACITY", 20)
    for method in ("1pass", "3pass"):
        assert align.local_alignment("A" * 10, "A" * 10, align.simple(), method)[0] == 20
        with pytest.raises(OverflowError):
            align.local_alignment("A" * 11, "A" * 11, align.simple(), method)
    assert align.cell_type(10, 10, align.simple())[0] == "i4" and align.cell_type(1 << 26, 1 << 26, align.simple(127))[0] == "i8"


def test_strands_best_match_and_lines(spark):
    queries = spark.createDataFrame([(0, "q0 x", "TTGGACC", "ABCDEFG"), (1, "q1", "GGTCCAA", None), (2, "q2", "", "")], "ord long, header string, sequence string, quality string")
    refs = spark.createDataFrame([(0, "a first", "CCTTGGACCTT"), (1, "b", "TTGGACC")], "ref_ord int, name string, ref string")
    done = align.align(queries, refs, align.simple(), rev_comp=True, best_match=True)
    lines = {r["ord"]: r["line"].split("\t") for r in align.sam_rows(done).collect()}
    assert lines[0] == ["q0", "0", "b", "1", "255", "7M", "*", "0", "0", "TTGGACC", "ABCDEFG", "AS:i:14"]
    assert lines[1][1] == "16" and lines[1][9:11] == ["TTGGACC", "*"]
    assert lines[2][1:3] == ["4", "*"]
    assert align.sam_rows(done, exclude_unmapped=True).count() == 2
    assert [r["line"] for r in align.sam_header(refs).orderBy("row").collect()] == ["@HD\tVN:1.4", "@SQ\tSN:a\tLN:11", "@SQ\tSN:b\tLN:7"]


@pytest.mark.parametrize("method, rev_comp, best_match", [("1pass", True, True), ("3pass", False, False), ("scores", True, False), ("1pass", False, True)])
def test_grid_of_blocks_gives_what_a_broadcast_gives(spark, monkeypatch, method, rev_comp, best_match):
    draw = random.Random(8)
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    queries = spark.createDataFrame([(i, f"q{i}", letters(i % 23), None if i % 3 else "I" * (i % 23)) for i in range(60)], "ord long, header string, sequence string, quality string")
    refs = spark.createDataFrame([(i, f"r{i}", letters(30) if i % 4 else "ACGTACGTACGT") for i in range(13)], "ref_ord int, name string, ref string")
    scoring = align.simple(2, 3, gap_open=4, gap_extend=1)
    wanted = align.align(queries, refs, scoring, rev_comp, best_match, method)
    wanted_rows = sorted(wanted.collect(), key=str)
    monkeypatch.setattr(align, "BROADCAST_LETTERS", 60)
    monkeypatch.setattr(align, "LINE_LETTERS", 100)
    monkeypatch.setattr(align, "CELL_PAIRS", 7)
    found = align.align(queries, refs, scoring, rev_comp, best_match, method)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == wanted.columns and sorted(found.collect(), key=str) == wanted_rows
    assert align.align(queries.limit(0), refs, scoring, rev_comp, best_match, method).count() == 0


def test_options():
    with pytest.raises(ValueError):
        align.simple(gap_open=1, gap_extend=2)
    with pytest.raises(ValueError):
        align.simple(alphabet="aa", match=1, ignore_n=True)
    scoring = align.named("# a comment\n   A  R\nA  4 -1\nR -1  5\n")
    assert align.local_alignment("ARA", "ARA", scoring)[0] == 13


def test_long_references_are_not_swept_whole_for_what_stands_in_them():
    """Pieces of two million letters, whole and with changes; a sweep of it takes seconds for each."""
    import time

    draw = random.Random(4)
    reference = "".join(draw.choices("ACGT", k=2_000_000))
    reference += reference[700_000:700_500]
    queries, wanted = [], []
    for k in range(40):
        at = draw.randrange(len(reference) - 1000)
        whole = reference[at : at + 96]
        middle = {"A": "C", "C": "G", "G": "T", "T": "A"}[whole[48]]
        queries += [whole, whole[:48] + middle + whole[49:]]
        wanted += [(192, reference.index(whole), "96M"), (187, reference.index(whole), "96M")]
    began = time.monotonic()
    assert align.local_alignments(queries, [reference] * len(queries), align.simple(2, 3, gap_open=4, gap_extend=1), "3pass") == wanted
    assert time.monotonic() - began < 60
    assert align.local_alignments([reference[700_100:700_200]], [reference], align.simple(), "3pass") == [(200, 700_100, "100M")]  # the first of two


@pytest.mark.parametrize("scoring", [align.simple(2, 3, gap_open=4, gap_extend=1), align.simple(3, 2, gap_open=3, gap_extend=3), align.simple(1, 1, gap_open=0, gap_extend=0), align.simple(2, 1, ignore_n=True, gap_open=2, gap_extend=0)])
def test_seeds_give_what_a_sweep_gives(monkeypatch, scoring):
    draw = random.Random(6)
    letters = lambda n, of="ACGT": "".join(draw.choices(of, k=n))
    reference = letters(6000)
    reference += reference[500:700] + letters(50) + reference[5000:5060] + "N" + reference[5061:5100] + letters(300, "AC") + "A" * 100
    queries = [reference[550:650], reference[5000:5100], letters(50), "ACGT", "A" * 40]
    for _ in range(25):
        at = draw.randrange(len(reference) - 120)
        q = list(reference[at : at + 96])
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
            k = draw.randrange(len(q) - 3)
            q[k : k + draw.choice([0, 1, 1, 3])] = letters(draw.choice([0, 1, 1, 2]), "ACGTN")
        queries.append("".join(q))
    found = {}
    for long in (1 << 10, 1 << 30):
        monkeypatch.setattr(align, "LONG", long)
        found[long] = align.local_alignments(queries, [reference] * len(queries), scoring, "3pass"), align.best_cells(queries, [reference] * len(queries), scoring)
    assert found[1 << 10] == found[1 << 30]


def test_scores_of_a_shared_reference_are_swept_side_by_side():
    """Tallies: many short queries, few references; the plain recurrence's scores, in a fraction of a sweep by pairs."""
    import time

    draw = random.Random(12)
    letters = lambda n: "".join(draw.choices("ACGTN", k=n))
    scoring = align.simple(2, 3, gap_open=4, gap_extend=1)
    reference, queries = letters(64), [letters(draw.randrange(0, 50)) for _ in range(20_000)]
    began = time.process_time()
    scores = align.local_scores(queries, [reference] * len(queries), scoring)
    assert time.process_time() - began < 1.2  # some 2.5 s by pairs
    assert [scores[i] for i in range(0, 20_000, 400)] == [brute(queries[i], reference, scoring) if queries[i] else 0 for i in range(0, 20_000, 400)]


def test_ways_of_a_shared_reference_are_those_of_pairs():
    draw = random.Random(13)
    letters = lambda n: "".join(draw.choices("ACGTN", k=n))
    reference = letters(64)
    queries = [reference[a : a + 20] + reference[a + 24 : a + 40] for a in range(0, 30, 3)] + [letters(draw.randrange(1, 50)) for _ in range(40)]
    for scoring in (align.simple(2, 3, gap_open=4, gap_extend=1), align.simple(1, 1, gap_open=0, gap_extend=0), align.simple(127, 127, gap_open=127, gap_extend=1)):
        assert align.traced_alike(queries, reference, scoring) == [align.local_alignment(q, reference, scoring) for q in queries]


def test_best_match_shuffles_nothing_and_looks_once(spark):
    queries = spark.createDataFrame([(i, f"q{i}", "ACGTTGCATGCC"[i % 5 :], None) for i in range(20)], "ord long, header string, sequence string, quality string")
    refs = spark.createDataFrame([(i, f"r{i}", "ACGTTGCATGCC") for i in range(3)], "ref_ord int, name string, ref string")
    done = align.align(queries, refs, align.simple(), rev_comp=True, best_match=True)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange hashpartitioning" not in plan
    assert {(r["ref_ord"], r["strand"]) for r in done.collect()} == {(2, "+")}  # the last of equals


@pytest.mark.parametrize("scoring, kind", [(align.simple(2, 3, gap_open=4, gap_extend=1), "u1"), (align.simple(60, 50, gap_open=70, gap_extend=20), "i2"), (align.simple(1, 0, gap_open=0, gap_extend=0), "u1")])
def test_references_of_unlike_lengths_are_swept_in_the_smallest_cells(scoring, kind):
    """Tallies: one table of all queries and references, in bytes where scores allow it."""
    draw = random.Random(14)
    letters = lambda n: "".join(draw.choices("ACGTNacgtRY", k=n))
    references = [letters(n) for n in (40, 3, 41, 0, 44, 1, 17, 40)]
    queries = [None, "", *(letters(draw.randrange(1, 30)) for _ in range(30)), references[0], references[4][5:20] + references[4][23:]]
    known = lambda s: "".join(c if c in "ACGTN" else "N" for c in s.upper())
    table = align.score_table(queries, references, scoring)
    assert table.tolist() == [[brute(known(q), known(r), scoring) if q and r else 0 for q in queries] for r in references]
    assert {lot.weighed.dtype.str[1:] for lot in align.lots_of(queries, 44, scoring, lambda n, size: 7)} == {kind}


def test_tallies_look_at_the_queries_once(spark):
    queries = spark.createDataFrame([(i, f"q{i}", "ACGTTGCATGCC" * (1 + 30 * (i == 3)), None) for i in range(10)] + [(10, "q10", None, None)], "ord long, header string, sequence string, quality string")
    refs = spark.createDataFrame([(i, f"r{i}", "ACGTTGCATGCC" * (i + 1)) for i in range(3)], "ref_ord int, name string, ref string")
    wanted = {3: ((11, 9, 3, 12, 33, 33), (11, 9, 3, 12, 66, 66)), 0: ((11, 9, 0, None, 0, None),) * 2}
    for n in (3, 0):
        for rev_comp in (False, True):
            own = refs.limit(n)
            done = align.tallies(queries, own, align.align(queries, own, align.simple(), method="scores"), rev_comp)
            assert tuple(done.first()) == wanted[n][rev_comp]
            assert done._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("scoring", [align.simple(2, 3, gap_open=4, gap_extend=1), align.simple(1, 1, gap_open=1, gap_extend=0), align.simple(100, 90, gap_open=20, gap_extend=20), align.simple(2, 1, ignore_n=True, gap_open=2, gap_extend=1)])
def test_ways_along_diagonals_are_those_of_whole_tables(monkeypatch, scoring):
    """All scores: gaps on both sides, ties, letters of either case, and pairs whose tables don't fit in the space of a lot."""
    draw = random.Random(15)
    letters = lambda n: "".join(draw.choices("ACGTNacgtRY", k=n))
    reference = letters(50)
    queries = [letters(draw.randrange(1, 40)) for _ in range(60)] + [reference[a : a + 12] + letters(draw.randrange(4)) + reference[a + 12 + draw.randrange(5) : a + 30] for a in range(20)] + ["A" * 30]
    wanted = [align.swept([q], [reference], scoring)[0] for q in queries]
    assert any("D" in x[2] for x in wanted if x) and any("I" in x[2] for x in wanted if x)
    for room in (1 << 24, 1 << 16, 1 << 14):
        monkeypatch.setattr(align, "TABLE_BYTES", room)
        assert align.traced_alike(queries, reference, scoring) == wanted


def test_runs_of_ways():
    assert align.runs_of(align.np.array([[0, 0, 1, 1, 2], [3, 1, 3, 3, 3], [0, 0, 0, 0, 0], [0, 0, 0, 0, 1], [1, 1, 1, 1, 1]], "u1")) == ["2M1I", "1D1M3D", "", "1M", "5M"]


@pytest.mark.parametrize("method", ["1pass", "scores"])
def test_best_of_many_references_is_that_of_all_pairs(spark, method):
    """Best match: more references than one block, of equal scores the last; every pair by the plain tables."""
    draw = random.Random(16)
    letters = lambda n: "".join(draw.choices("ACGTN", k=n))
    texts = [letters(draw.randrange(8, 30)) for _ in range(37)] + ["ACGTACGTAC"] * 2
    own = [letters(draw.randrange(0, 25)) for _ in range(30)] + ["ACGTACGTAC", "GTACGTACGT", texts[3], None]
    queries = spark.createDataFrame([(i, f"q{i}", s, None) for i, s in enumerate(own)], "ord long, header string, sequence string, quality string")
    refs = spark.createDataFrame([(i, f"r{i}", r) for i, r in enumerate(texts)], "ref_ord int, name string, ref string")
    scoring = align.simple(2, 3, gap_open=4, gap_extend=1)
    both = lambda s: [s, s and align.bases.complemented(s)]
    wanted = {}
    for i, s in enumerate(own):
        for k, r in enumerate(texts):
            forward, backward = (align.swept([x], [r], scoring)[0] if x else None for x in both(s))
            back = (backward or (0,))[0] > (forward or (0,))[0]
            score, start, cigar = (backward if back else forward) or (None,) * 3
            wanted[i, k] = ("-" if back else "+", score, *((start, cigar) if method == "1pass" else (None, None)))
    fields = lambda x: (x["strand"], x["score"], x["ref_start"], x["cigar"])
    every = align.align(queries, refs, scoring, rev_comp=True, method=method).collect()
    assert {(x["ord"], x["ref_ord"]): fields(x) for x in every} == wanted and len(every) == len(wanted)
    best = {x["ord"]: (x["ref_ord"], *fields(x)) for x in align.align(queries, refs, scoring, True, True, method).collect()}
    tops = {i: max(range(len(texts)), key=lambda k: (wanted[i, k][1] or 0, k)) for i in range(len(own))}
    assert best == {i: (k, *wanted[i, k]) for i, k in tops.items()}


def test_strands_and_references_are_scored_without_objects_by_pair():
    """A table of numbers for each strand; ways are looked for once a query."""
    best, wins, found = align.best_placed(["ACGTTGCA", "", "TTTTTTTT", None] * 3, ["ACGTTGCA", "AAAAAAAA", "GGGG"], [0, 1, 2], align.simple(), "scores", True)
    assert best.tolist() == [0, 2, 1, 2] * 3 and wins.tolist() == [False, False, True, False] * 3 and found.tolist() == [16, 0, 16, 0] * 3
