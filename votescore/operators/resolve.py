"""Account names to ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def missing_account(name) -> F.Column:
    return F.raise_error(F.concat(F.lit("Account '"), name, F.lit("' does not exist")))


def names_in(ops: DataFrame) -> DataFrame:
    """Distinct author and voter names of the operations."""
    authors = ops.select(F.col("author").alias("name"))
    voters = ops.where(F.col("voter").isNotNull()).select(F.col("voter").alias("name"))
    return authors.union(voters).distinct()


def account_ids(names: DataFrame, accounts: DataFrame) -> DataFrame:
    """(name, id) of the known names."""
    return names.join(accounts, "name", "inner").select("name", "id")


def resolve_ops(ops: DataFrame, accounts: DataFrame, strategy: str | None = None) -> DataFrame:
    """Operations with ids. An unknown author drops the operation, an unknown voter gives NULL.

    Operations without a permlink cannot belong to a post and are dropped as well. The planner broadcasts the
    accounts by their size in bytes, or else splits the partitions of frequent names and of missing voters;
    `strategy` is a join hint that overrides it.
    """
    posts = ops.where(F.col("permlink").isNotNull() & F.col("author").isNotNull())
    authors = accounts.select(F.col("name").alias("_author"), F.col("id").alias("author_id"))
    voters = accounts.select(F.col("name").alias("_voter"), F.col("id").alias("voter_id"))
    if strategy:
        authors, voters = authors.hint(strategy), voters.hint(strategy)
    return (
        posts.join(authors, posts["author"] == authors["_author"], "inner")
        .join(voters, posts["voter"] == voters["_voter"], "left")
        .select("author_id", "voter_id", "permlink", "rshares", "source_op", "is_vote")
    )


def resolve_accounts(names: DataFrame, accounts: DataFrame, required: bool = True) -> DataFrame:
    """(name, id) for given names; unknown names raise, a missing name raises only when required."""
    known = accounts.select("name", "id")
    found = names.select("name").join(known, "name", "left")
    refuse = F.col("id").isNull()
    if not required:
        refuse = refuse & F.col("name").isNotNull()
    shown = F.coalesce(F.col("name"), F.lit("<NULL>"))
    return found.select("name", F.when(refuse, missing_account(shown).cast("int")).otherwise(F.col("id")).alias("id"))


def unknown_names(names: DataFrame, accounts: DataFrame) -> DataFrame:
    """Names without an account, as a report instead of an error."""
    return names.where(F.col("name").isNotNull()).select("name").join(accounts, "name", "left_anti")
