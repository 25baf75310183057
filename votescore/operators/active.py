"""The table of active votes and the effect of a range on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore.operators.links import STORED, VOTE


def _standing() -> Column:
    """No removal of the post after this row."""
    return F.col("removed_last").isNull() | (F.col("removed_last") < F.col("source_op"))


def _kept() -> Column:
    """A vote of an unknown voter has no chain; it is always a candidate, and refused below."""
    return _standing() & (F.col("is_latest") | F.col("voter_id").isNull())


def removed_votes(linked: DataFrame) -> DataFrame:
    """Stored votes of posts that the range removes, whoever cast them."""
    return linked.where((F.col("kind") == STORED) & F.col("removed_last").isNotNull()).select(
        "author_id", "voter_id", "permlink", "rshares")


def surviving_votes(linked: DataFrame) -> DataFrame:
    """Newest votes of the range whose post is not removed later in it."""
    return linked.where((F.col("kind") == VOTE) & F.col("is_latest") & _standing()).select(
        "author_id", "voter_id", "permlink", "rshares", "source_op")


def next_active_votes(linked: DataFrame) -> DataFrame:
    """Stored votes after the range: removed posts are cleared, then the newest votes win.

    A vote that would have to be stored without a known voter or without a weight is an error.
    """

    def required(name: str, kind: str) -> Column:
        problem = F.concat(F.lit(f"vote without {name} at operation "), F.col("source_op").cast("string"))
        return F.when(F.col(name).isNull(), F.raise_error(problem).cast(kind)).otherwise(F.col(name)).alias(name)

    return linked.where(F.col("kind").isin(STORED, VOTE) & _kept()).select(
        "author_id", required("voter_id", "int"), "permlink", required("rshares", "long"))


def vote_changes(linked: DataFrame) -> DataFrame:
    """What the range changes in the stored votes: new and changed votes, and with `gone` those of removed posts."""
    held = (F.col("kind") == STORED) | F.col("stored_rshares").isNotNull()
    gone = linked.where(F.col("is_latest") & ~_standing() & held).select(
        "author_id", "voter_id", "permlink", "rshares", F.lit(True).alias("gone"))
    return next_active_votes(linked.where(F.col("kind") == VOTE)).withColumn("gone", F.lit(False)).unionByName(gone)


def effects() -> list[Column]:
    """Counts over linked rows: stored votes deleted, votes stored, votes queued for the reputation step."""
    deleted = (F.col("kind") == STORED) & F.col("removed_last").isNotNull()
    stored = (F.col("kind") == VOTE) & F.col("is_latest") & _standing()
    return [F.count_if(deleted).alias("deleted_votes"), F.count_if(stored).alias("upserted_votes"),
            F.count_if(F.col("kind") == VOTE).alias("queued_votes")]


def batch_effects(linked: DataFrame) -> DataFrame:
    """One row with the counts of a range."""
    return linked.agg(*effects())


def quarantine(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits resolved operations into usable ones and votes that could not be stored."""
    bad = F.col("is_vote") & (F.col("voter_id").isNull() | F.col("rshares").isNull())
    return ops.where(~bad), ops.where(bad)
