"""Comparing reputations with expected values.

Large tables that hardly differ are compared by digests first: a number of rows, a sum and an exclusive or of hashes per bucket
of accounts, whatever the order of the rows. Only rows of buckets whose digests differ are joined.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore import schemas

#: Buckets of accounts for tables that do not lie in buckets.
BUCKETS = 1024


def expected_diff(expected: DataFrame, current: DataFrame, strict: bool = False) -> DataFrame:
    """Accounts whose values differ. Accounts absent on one side count only with `strict`."""
    left = expected.select("account_id", F.col("reputation").alias("expected"))
    right = current.select("account_id", F.col("reputation").alias("current"))
    if strict:
        joined = left.join(right, "account_id", "full_outer")
        return joined.where(~F.col("expected").eqNullSafe(F.col("current"))).select("account_id")
    joined = left.join(right, "account_id", "left")
    return joined.where(F.col("expected") != F.col("current")).select("account_id")


def diff_detail(expected: DataFrame, current: DataFrame, ids: DataFrame) -> DataFrame:
    """Expected and current row of the given accounts, one below the other."""

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.join(ids.select("account_id").distinct(), "account_id", "left_semi").select(
            F.lit(name).alias("side"), "account_id", "reputation")

    return side("expected", expected).unionByName(side("current", current))


def bucket_of_account(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("account_id").cast("int")), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, bucket: Column) -> DataFrame:
    """bucket, digest of the accounts and reputations in it: one row per bucket, pre-aggregated where the rows are."""
    row = F.struct(F.col("account_id").cast("int"), F.col("reputation").cast("long"))
    hashed = rows.select(bucket.alias("bucket"), F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    return hashed.groupBy("bucket").agg(F.struct(
        F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.bit_xor("b")).alias("digest"))


def differing_buckets(expected: DataFrame, current: DataFrame, bucket: Column) -> list[int]:
    """Buckets whose rows differ: at most one number per bucket."""
    left = digests(expected, bucket).withColumnRenamed("digest", "left")
    both = left.join(digests(current, bucket).withColumnRenamed("digest", "right"), "bucket", "full_outer")
    return sorted(r.bucket for r in both.where(~F.col("left").eqNullSafe(F.col("right"))).select("bucket").collect())


def diff_by_digests(expected: DataFrame, current: DataFrame, strict: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """`expected_diff` that joins the rows of differing buckets only. Equal digests of different rows would take two
    64-bit hashes at once that agree by chance."""
    bucket = bucket_of_account(buckets)
    found = differing_buckets(expected, current, bucket)
    if not found:
        return expected.sparkSession.createDataFrame([], schemas.REPUTATION).select("account_id")
    return expected_diff(expected.where(bucket.isin(found)), current.where(bucket.isin(found)), strict)
