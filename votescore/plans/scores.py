"""Scores of accounts, and a committed state against expected values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.functions.score import score
from votescore.operators.compare import differing_buckets, expected_diff
from votescore.operators.resolve import missing_account
from votescore.plans.state import REPUTATION, StateStore
from votescore.session import counted


def scores(reputation: DataFrame, accounts: DataFrame) -> DataFrame:
    """Score of every account; 0 without reputation."""
    state = reputation.select(F.col("account_id").alias("id"), "reputation")
    return (
        accounts.select("id", "name").join(state, "id", "left")
        .select(F.col("id").alias("account_id"), "name", score(F.col("reputation")).alias("score"))
    )


def account_score(names: DataFrame, reputation: DataFrame, accounts: DataFrame) -> DataFrame:
    """Scores of the given names; an unknown name is an error.

    Both tables are first reduced to the names asked for, so a short list costs no shuffle of them.
    """
    wanted = names.select("name").distinct()
    known = accounts.select("id", "name").join(wanted, "name", "left_semi")
    state = (
        reputation.select(F.col("account_id").alias("id"), "reputation")
        .join(known.select("id"), "id", "left_semi")
    )
    return wanted.join(known, "name", "left").join(state, "id", "left").select(
        "name",
        F.when(F.col("id").isNull(), missing_account(F.coalesce("name", F.lit("<NULL>"))).cast("int"))
        .otherwise(score(F.col("reputation"))).alias("score"),
    )


def committed_score(store: StateStore, names: DataFrame, accounts: DataFrame) -> DataFrame:
    """Scores of the given names in a committed state. The buckets of their accounts are computed first, and only their
    files are read: for one name one bucket."""
    head, wanted = store.latest(), names.select("name").distinct()
    known, seen = counted(
        wanted.join(accounts.select("name", "id"), "name", "left").where("id is not null"),
        F.collect_set(store.bucket_of(REPUTATION, head, "id")).alias("buckets"))
    return account_score(wanted, store.reputation(head, sorted(seen["buckets"])), known)


def committed_diff(store: StateStore, expected: DataFrame, strict: bool = False) -> DataFrame:
    """Accounts whose expected value differs from a committed state; rows are read of buckets whose digests differ."""
    head = store.latest()
    bucket = store.bucket_of(REPUTATION, head)
    found = differing_buckets(expected, store.reputation(head), bucket)
    return expected_diff(expected.where(bucket.isin(found)), store.reputation(head, found), strict)
