from pyspark.sql import functions as F

from readloom.functions import headers

TAIL = "NB551068:77:HVX2KBGXC:3:21508:4410:19922"
PLACE = "VH00481:5:AAC7NTKM5:1:1410:27831:5509"
#: header, molecule, side, header with side 0 put in, merged name
VECTORS = [
    (f"ERR7340112.52 {TAIL} length=101", "ERR7340112.52", "0", f"ERR7340112.52.0 {TAIL} length=101", f"ERR7340112.52.3 {TAIL} length=101"),
    (f"ERR7340112.52.1 {TAIL} length=101", "ERR7340112.52", "1", f"ERR7340112.52.1 {TAIL} length=101", f"ERR7340112.52.3 {TAIL} length=101"),
    (f"{PLACE}/1", PLACE, "1", f"{PLACE}/1", f"{PLACE}/3"),
    (f"{PLACE} 2:Y:0:TTAGGC", PLACE, "2", f"{PLACE} 2:Y:0:TTAGGC", f"{PLACE} 3:Y:0:TTAGGC"),
    (f"{PLACE}_2:Y:0:GGCA", PLACE, "2", f"{PLACE}_2:Y:0:GGCA", f"{PLACE}_3:Y:0:GGCA"),
    (f"lane_7-{PLACE}_1:Y:0:GGCA", f"lane_7-{PLACE}", "1", f"lane_7-{PLACE}_1:Y:0:GGCA", f"lane_7-{PLACE}_3:Y:0:GGCA"),
    (f"DRR0091822.7_{TAIL}_length=75", "DRR0091822.7", "0", f"DRR0091822.7.0_{TAIL}_length=75", f"DRR0091822.7.3_{TAIL}_length=75"),
    (f"DRR0091822.7.1_{TAIL}_length=75", "DRR0091822.7", "1", f"DRR0091822.7.1_{TAIL}_length=75", f"DRR0091822.7.3_{TAIL}_length=75"),
    ("SRR5550123.40 2:Y:7:none", "SRR5550123.40", "0", "SRR5550123.40.0 2:Y:7:none", "SRR5550123.40.3 2:Y:7:none"),
    ("SRR5550123.40.9 other", "SRR5550123.40", "0", "SRR5550123.40.9 other", "SRR5550123.40.3 other"),
    ("nothing known", "nothing", "0", "nothing known", "nothing 3"),
    ("nothing", None, None, "nothing", "nothing"),
    ("x  1:N", "x", "0", "x  1:N", "x 3:N"),
]


def test_dialects(spark):
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "h string")
    got = df.select("h", headers.molecule(F.col("h")).alias("m"), headers.repaired(F.col("h"), F.lit("0")).alias("r"), headers.merged_name(F.col("h")).alias("n")).collect()
    for row, (_, name, side, repaired, merged) in zip(got, VECTORS):
        assert (row["m"] and tuple(row["m"])) == ((name, side) if name else None), row["h"]
        assert row["r"] == repaired
        assert row["n"] == merged


def test_same_molecule_ignores_sides(spark):
    df = spark.createDataFrame([("a 1:N", "a 2:N"), ("a 1:N", "a 1:N"), ("a 1:N", "b 1:N"), ("a", "a")], "x string, y string")
    assert [r[0] for r in df.select(headers.same_molecule(F.col("x"), F.col("y"))).collect()] == [True, True, False, False]


def test_first_token(spark):
    df = spark.createDataFrame([("a b",), ("  a",), ("",), ("\tq\tr",)], "h string")
    assert [r[0] for r in df.select(headers.first_token(F.col("h"))).collect()] == ["a", "a", "*", "q"]
