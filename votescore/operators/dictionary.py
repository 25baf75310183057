"""Permlink dictionary: strings to stable integer ids."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votescore.session import cut_lineage

# Strings that one task numbers.
BUCKET_STRINGS = 1_000_000


def new_entries(dictionary: DataFrame, strings: DataFrame, buckets: int | None = None) -> DataFrame:
    """Ids for the strings the dictionary lacks, above its highest id and without gaps.

    Rows are numbered inside hash buckets in parallel; a bucket starts after the sum of the sizes of
    the buckets before it, and the first after the highest id in use. Only the bucket sizes (one row
    per bucket) meet in one place.
    """
    # Written once: the numbering, the bucket sizes and the number of buckets read it.
    unseen = cut_lineage(
        strings.where(F.col("permlink").isNotNull()).select("permlink").distinct()
        .join(dictionary, "permlink", "left_anti")
    )
    if buckets is None:
        tasks = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(tasks, -(-unseen.count() // BUCKET_STRINGS))
    unseen = unseen.withColumn("bucket", F.pmod(F.xxhash64("permlink"), F.lit(buckets)).cast("int"))
    in_use = dictionary.agg(F.lit(-1).alias("bucket"), F.coalesce(F.max("permlink_id"), F.lit(0)).alias("n"))
    sizes = unseen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).unionByName(in_use)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.sum("n").over(before).alias("start"))
    numbered = unseen.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("permlink")))
    return (
        numbered.join(F.broadcast(starts), "bucket")  # buckets + 1 rows
        .select((F.col("start") + F.col("n")).cast("long").alias("permlink_id"), "permlink")
    )


def extend_dictionary(dictionary: DataFrame, strings: DataFrame, buckets: int | None = None) -> DataFrame:
    """The dictionary with the unseen strings added; existing ids stay."""
    return dictionary.select("permlink_id", "permlink").unionByName(new_entries(dictionary, strings, buckets))


def batch_dictionary(dictionary: DataFrame, strings: DataFrame) -> DataFrame:
    """The part of the dictionary that a batch needs: entries of the strings that occur in it."""
    return dictionary.select("permlink_id", "permlink").join(strings.select("permlink"), "permlink", "left_semi")


def encode(ops: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Operations with the permlink replaced by its id. The planner splits the partitions of frequent permlinks."""
    return ops.join(dictionary.select("permlink", "permlink_id"), "permlink").drop("permlink")
