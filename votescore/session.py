"""Where intermediate results that must outlive an executor are written."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: `spark.checkpoint.dir`, or the directory set on the context.

    Only a local master may fall back to a temporary folder, because there the driver and the
    executors are one machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    base = tempfile.mkdtemp(prefix="votescore-")
    sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/votescore/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan is cut and the rows survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def measured(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back, so that the planner knows their size.

    A checkpoint keeps the estimate of its plan, and that of a join or cogroup is the product of both sides. In a loop whose
    result meets itself again the number of its digits doubles each time, until the estimates alone fill the driver.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(rows: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """The rows, checkpointed, with their number `n` and other aggregates, which are taken on the way."""
    taken = Observation()
    kept = cut_lineage(rows.observe(taken, F.count(F.lit(1)).alias("n"), *metrics))
    return kept, taken.get


@contextmanager
def kept_partitions(spark: SparkSession) -> Iterator[None]:
    """Frames checkpointed inside keep the partitioning they were given, so that later steps need no shuffle. Adaptive
    execution would hide it from them; it is back as it was afterwards."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
