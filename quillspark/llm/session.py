"""What the operators need of the session: the shared folder, written tables, code on the executors."""

from __future__ import annotations

import contextlib
import inspect
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/quillspark-shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


BATCH_BYTES = 16 << 20


def importable(spark: SparkSession) -> None:
    """Python workers of a local session find this package though it isn't installed, and get Arrow batches of bounded bytes where the
    session doesn't bound them itself."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, paths)))


def released() -> None:
    """Gives the memory that this Python worker no longer uses back to the machine; idle workers stay alive beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, for mapInArrow (a generator over batches) or applyInArrow (a function of a table), with released() at its end."""
    if inspect.isgeneratorfunction(run):

        def over(batches):
            try:
                yield from run(batches)
            finally:
                released()

        return over

    def of(rows):
        try:
            return run(rows)
        finally:
            released()

    return of


def stored(df: DataFrame) -> DataFrame:
    """df written once, as Parquet, to the shared folder: its lineage ends there, and a lost executor costs nothing that is in it.
    The files go with that folder, whose upkeep is the cluster's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SAME_EACH_TIME = {"LogicalRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation", "LocalRelation", "Project", "Filter", "Union", "SubqueryAlias", "View"}


def steady(df: DataFrame) -> DataFrame:
    """df as operators need it that read it more than once: itself where its plan is tables, projections and filters alone, else stored.
    A limit, a sample or a shuffle may give other rows, or another order, each time."""

    def same(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in SAME_EACH_TIME and all(same(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().analyzed()
    return df if plan.deterministic() and same(plan) else stored(df)


def slots(spark: SparkSession, parts: int) -> list[int]:
    """For each partition of a repartition(parts, number) the least number that goes there, so that parts are dealt one to a partition."""
    found: dict[int, int] = {}
    size = 16
    while len(found) < parts:
        size *= 2
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")
        found = {r.at: r.least for r in spark.range(0, size * parts, numPartitions=1).groupBy(at).agg(F.min(F.col("id").cast("int")).alias("least")).collect()}
    return [found[p] for p in range(parts)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
