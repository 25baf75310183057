"""Long logs in waves: consecutive parts that are folded one after the other."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.functions.branch import count_at_or_below
from votescore.session import scratch_path


def in_waves(votes: DataFrame, wanted: int, most: int) -> Iterator[tuple[DataFrame, int]]:
    """The votes in parts by operation, each with its number of pieces: one part of `wanted` pieces, or several of `most`.

    Several parts are written once, a folder for each, so a wave reads its own votes and not those of all waves. Files
    hold ranges of operations, hence a task writes to one or two folders.
    """
    parts = -(-wanted // most)
    if parts == 1:
        yield votes, wanted
        return
    shares = [i / parts for i in range(1, parts)]
    points = votes.agg(F.percentile_approx("source_op", shares, 100 * parts).alias("at")).first()["at"]
    borders = sorted(set(points))
    spark, path = votes.sparkSession, scratch_path(votes.sparkSession, "waves")
    # Votes without an operation number sort first.
    wave = F.coalesce(count_at_or_below(F.col("source_op") - 1, borders).cast("int"), F.lit(0))
    votes.repartitionByRange("source_op").withColumn("wave", wave).write.partitionBy("wave").parquet(path)
    dealt = spark.read.parquet(path)
    for k in range(len(borders) + 1):
        yield dealt.where(F.col("wave") == k).drop("wave"), most
