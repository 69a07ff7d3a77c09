"""What operators need of the cluster: a shared folder, durable cuts of lineage, exact numbering, parallelism."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A partition that is dealt out anew gets so many rows at least.
SPREAD_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing names one a temporary one is set in a local session; on a
    cluster, whose machines could not read it, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` as rows in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes what ``durable`` wrote for ``df``, once nothing reads it any more: of rounds, all but the last copy."""
    context = df.sparkSession.sparkContext
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it lies in fewer partitions with rows than there are cores, as tables of few row groups do.

    Larger inputs, of four partitions a core or more, are left as they are without being looked at.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    counts = df.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("rows")).first()
    wanted = min(cores, (counts["rows"] or 0) // SPREAD_ROWS)
    return df.repartition(wanted) if counts["parts"] < wanted else df


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with 0, 1, 2 ... in ``order`` as a long column, without bringing all rows to one task.

    Rows are dealt by ranges and sorted there; a number is the rows of earlier ranges and the place in its own. Only
    the row count of each range reaches the driver.
    """
    dealt = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for number, n in sizes:
        before += [F.lit(number), F.lit(total)]
        total += n
    if not before:
        return dealt.drop("_range", "_at").withColumn(name, F.lit(0).cast("long"))
    start = F.try_element_at(F.create_map(*before), F.col("_range")).cast("long")
    return dealt.withColumn(name, start + F.col("_at") - F.shiftleft(F.col("_range").cast("long"), 33)).drop("_range", "_at")


def processors(physical: bool = False, halved: bool = False, env: Mapping[str, str] | None = None, cap: bool = True) -> int:
    """Processors to use: an override wins, even over the cores there are; else a cluster's or a local limit caps them.

    ``halved`` takes half, at least 1; ``physical`` counts cores and not threads where the system tells them.
    """
    env = os.environ if env is None else env
    number = lambda name: int(env[name]) if env.get(name, "").isdigit() else None
    if override := number("LOCAL_PROCS_OVERRIDE"):
        found = override
    else:
        found = os.cpu_count() or 1
        if physical:
            try:
                cores = {tuple(sorted(x.split(",")))[0] for n in range(found) for x in [open(f"/sys/devices/system/cpu/cpu{n}/topology/thread_siblings_list").read().strip()]}
                found = len(cores) or found
            except OSError:
                pass
        limit = number("NSLOTS")
        limit = number("IFX_LOCAL_PROCS") if limit is None else limit  # 0 is no limit
        if cap and limit:
            found = min(found, limit)
    return max(1, found // 2) if halved else found
