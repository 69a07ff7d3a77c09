"""Neighbours paired by the task that reads them, whatever the partitions and the order."""

import pytest
from pyspark.sql import functions as F

from readloom.operators import pairing, trim, trimmer

KIND = "src int, ord long, header string, sequence string, quality string"


def reads(spark, n, parts):
    rows = [(1 + i % 2, i, f"m{i // 2} {1 + i % 2}:N", "ACGT"[i % 4] * (i % 9), "I" * (i % 9)) for i in range(n)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), KIND)


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (3, 1), (7, 2), (7, 3), (40, 10_000)])
def test_any_partitions_and_batches(spark, parts, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for df in (reads(spark, 46, parts), reads(spark, 46, parts).repartition(5), reads(spark, 46, parts).orderBy(F.col("ord").desc())):
            pairs = sorted((r["pair_idx"], r["r1"]["ord"], r["r2"]["ord"], r["r1"]["src"], r["r2"]["header"]) for r in pairing.deinterleave(df).collect())
            assert pairs == [(i, 2 * i, 2 * i + 1, 1, f"m{i} 2:N") for i in range(23)]
        with pytest.raises(Exception, match="extra first read: m23"):
            pairing.deinterleave(reads(spark, 47, parts)).collect()
        done = trimmer.trimmer([reads(spark, 46, parts)], trim.clipping(), filter_widows=True, min_length=3)
        want = [i for i in range(46) if min(i % 9, (i ^ 1) % 9) >= 3]
        assert sorted(r["ord"] for r in done.outputs[0].collect()) == want
        assert done.counts.first()["total_processed"] == 46
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairing.deinterleave(reads(spark, 46, parts).where("ord < 0")).count() == 0


def test_only_the_ends_of_partitions_are_shuffled(spark, tmp_path):
    df = reads(spark, 20_000, 4).where("ord <> 4 or true")
    ends = df.select(*pairing.READ).mapInArrow(lambda batches: pairing.neighbours(batches, alone=True), pairing.deinterleave(df, check=False).schema)
    assert ends.count() <= 2 * 4
    plan = trimmer.trimmer([df], trim.clipping(), filter_widows=True).outputs[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_mates_apart_are_an_error(spark):
    with pytest.raises(Exception, match="not next to each other"):
        pairing.adjacent(reads(spark, 10, 1).where("ord <> 3")).collect()
