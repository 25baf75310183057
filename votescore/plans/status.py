"""Reports on the progress records."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.functions.times import micros_between
from votescore.plans.state import latest

ACTIVE_WITHIN = timedelta(minutes=1)


def last_block(progress: DataFrame) -> DataFrame:
    """Block of the newest commit."""
    return latest(progress).select("last_block")


def sync_throughput(progress: DataFrame) -> DataFrame:
    """One row: ranges processed, total and mean seconds."""
    micros = F.sum(micros_between(F.col("started_at"), F.col("ended_at")))
    return progress.agg(F.count(F.lit(1)).alias("n_ranges"), micros.alias("micros")).select(
        "n_ranges", (F.col("micros") / 1e6).alias("total_seconds"),
        (F.col("micros") / F.col("n_ranges") / 1e6).alias("avg_seconds"))


def sync_status(progress: DataFrame, head_block: int, started_at: datetime, now: datetime | None = None) -> DataFrame:
    """Healthy when caught up with the head, or active in the last minute and since the start."""
    clock = F.lit(now) if now is not None else F.current_timestamp()
    row = latest(progress)
    return row.select(
        "last_block", F.col("ended_at").alias("last_active_at"),
        (F.col("last_block") >= head_block).alias("caught_up"),
        ((clock - F.col("ended_at") < F.lit(ACTIVE_WITHIN)) & (F.col("ended_at") > F.lit(started_at)))
        .alias("active"),
    ).withColumn("healthy", F.col("caught_up") | F.col("active"))
