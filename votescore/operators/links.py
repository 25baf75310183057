"""Linking every vote to the vote it replaces and to the removals of its post.

Stored active votes join the operations of a range as rows with `source_op` 0. They then sort before
every operation, so one window finds the previous vote whether it was stored or cast in the range,
and one window finds the removals around it. The post windows (author, permlink) and the chain
windows (author, permlink, voter) share a single shuffle by post.

A post that holds too many rows for one task is cut into pieces by operation id, as many as its rows
need. Inside a piece the same windows run; what lies in other pieces arrives through one summary row per
piece.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votescore.operators.skew import HOT_ROWS, hot_keys, in_runs, split_hot
from votescore.session import cut_lineage

STORED, VOTE, REMOVAL = 0, 1, 2

POST = ["author_id", "permlink"]
CHAIN = ["author_id", "permlink", "voter_id"]
ROW = ["author_id", "voter_id", "permlink", "rshares", "source_op", "kind"]
# Stored votes all have operation 0 and are ordered by voter.
RUN = ["author_id", "permlink", "source_op", "voter_id"]
LINKED = ROW + ["back_op", "back_rshares", "stored_rshares", "removed_before", "removed_last", "is_latest"]


def link_input(ops: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Resolved operations and stored votes as one set of rows. Operations have numbers above 0."""
    op = F.when(F.col("source_op") > 0, F.col("source_op")).otherwise(F.raise_error(F.lit("operation without a positive number")).cast("long"))
    rows = ops.withColumns({"kind": F.when(F.col("is_vote"), VOTE).otherwise(REMOVAL), "source_op": op}).select(*ROW)
    return rows if stored is None else with_stored(rows, stored)


def with_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    old = stored.withColumns({"source_op": F.lit(0).cast("long"), "kind": F.lit(STORED)}).select(*ROW)
    return rows.unionByName(old)


def hot_posts(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Posts with too many rows for one task, or None. A hot post has a hot author, so authors are counted
    first: usually that ends it, at the price of one row per author and map task."""
    authors = cut_lineage(hot_keys(rows, ["author_id"], hot_rows))
    if authors.isEmpty():
        return None
    posts = cut_lineage(hot_keys(rows.join(authors, "author_id", "left_semi"), POST, hot_rows))
    return None if posts.isEmpty() else posts


def _removal_op() -> Column:
    return F.when(F.col("kind") == REMOVAL, F.col("source_op"))


def _link_whole(rows: DataFrame) -> DataFrame:
    """Links when each post fits one task."""
    post = Window.partitionBy(*POST)
    earlier = post.orderBy("source_op").rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*CHAIN)
    steps = chain.orderBy("source_op")
    return rows.select(
        *ROW,
        F.max(_removal_op()).over(earlier).alias("removed_before"),
        F.max(_removal_op()).over(post).alias("removed_last"),
        F.lag("source_op").over(steps).alias("back_op"),
        F.lag("rshares").over(steps).alias("back_rshares"),
        F.max(F.when(F.col("kind") == STORED, F.col("rshares"))).over(chain).alias("stored_rshares"),
        (F.col("voter_id").isNotNull() & F.lead("source_op").over(steps).isNull()).alias("is_latest"),
    ).select(*LINKED)


def _link_pieces(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Links of hot posts: windows inside (post, piece), summaries across pieces."""
    cut = in_runs(rows, RUN, hot_rows)

    # Removals: the last one per piece, then over the pieces of the post.
    over_pieces = Window.partitionBy(*POST).orderBy("piece")
    around = cut.groupBy(*POST, "piece").agg(F.max(_removal_op()).alias("removed_in")).select(
        *POST, "piece",
        F.max("removed_in").over(over_pieces.rowsBetween(Window.unboundedPreceding, -1)).alias("removed_outside"),
        F.max("removed_in").over(Window.partitionBy(*POST)).alias("removed_last"),
    )

    # Chains: the last row per piece, then the piece before.
    chain = Window.partitionBy(*CHAIN)
    steps = chain.orderBy("piece")
    in_chain = cut.where(F.col("voter_id").isNotNull())
    last_row = F.max(F.struct("source_op", "rshares", "kind"))
    hand_over = (
        in_chain.groupBy(*CHAIN, "piece").agg(last_row.alias("last"))
        .select(
            *CHAIN, "piece",
            F.lag("last").over(steps).alias("back"),
            F.lead("piece").over(steps).isNull().alias("last_piece"),
            F.max(F.when(F.col("last.kind") == STORED, F.col("last.rshares"))).over(chain).alias("stored_rshares"),
        )
    )

    inside = Window.partitionBy(*POST, "piece").orderBy("source_op")
    inside_chain = Window.partitionBy(*CHAIN, "piece").orderBy("source_op")
    local = cut.select(
        *ROW, "piece",
        F.max(_removal_op()).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("removed_inside"),
        F.lag("source_op").over(inside_chain).alias("local_op"),
        F.lag("rshares").over(inside_chain).alias("local_rshares"),
        F.lead("source_op").over(inside_chain).isNull().alias("last_inside"),
    )
    first_inside = F.col("local_op").isNull()
    # NULL voters (removals, votes of unknown accounts) have no chain; `piece` and the post spread them.
    chained = local.where(F.col("voter_id").isNotNull()).join(hand_over, [*CHAIN, "piece"], "left")
    chainless = local.where(F.col("voter_id").isNull()).select(
        "*", F.lit(None).cast("struct<source_op:bigint,rshares:bigint,kind:int>").alias("back"),
        F.lit(False).alias("last_piece"), F.lit(None).cast("long").alias("stored_rshares"))
    return (
        chained.unionByName(chainless)
        .join(around, [*POST, "piece"])
        .select(
            *ROW,
            F.when(first_inside, F.col("back.source_op")).otherwise(F.col("local_op")).alias("back_op"),
            F.when(first_inside, F.col("back.rshares")).otherwise(F.col("local_rshares")).alias("back_rshares"),
            "stored_rshares",
            F.coalesce("removed_inside", "removed_outside").alias("removed_before"),
            "removed_last",
            (F.col("last_inside") & F.col("last_piece")).alias("is_latest"),
        ).select(*LINKED)
    )


def link(rows: DataFrame, hot_rows: int = HOT_ROWS, known_rows: int | None = None) -> DataFrame:
    """Adds to every row its previous row in the vote chain and the removals of its post.

    back_op, back_rshares   previous stored or cast vote of the same voter on the same post
    stored_rshares          the stored vote of the chain
    removed_before          last removal of the post before this row
    removed_last            last removal of the post in the range
    is_latest               no later vote in the chain

    With no more than `hot_rows` rows in all (`known_rows`, if they are counted) there is no hot post to look for.
    """
    posts = None if known_rows is not None and known_rows <= hot_rows else hot_posts(rows, hot_rows)
    if posts is None:
        return _link_whole(rows)
    hot, rest = split_hot(rows, POST, posts)
    return _link_whole(rest).unionByName(_link_pieces(hot, hot_rows))


def _votes(linked: DataFrame) -> DataFrame:
    """Votes with the weight they follow (the previous vote of the range, else the stored vote, else 0) and
    whether that is `cancelled`: the post was removed since, or the voter has no account."""
    since = F.coalesce("back_op", F.lit(0).cast("long"))
    removed = F.coalesce(F.col("removed_before") >= since, F.lit(False))
    return linked.where(F.col("kind") == VOTE).select(
        "author_id", "voter_id", "permlink", "rshares", "source_op",
        F.coalesce("back_rshares", "stored_rshares", F.lit(0).cast("long")).alias("followed"),
        (F.col("voter_id").isNull() | removed).alias("cancelled"))


def vote_transitions(linked: DataFrame) -> DataFrame:
    """One row per vote: its weight and the weight it replaces, which is 0 for a cancelled one."""
    return _votes(linked).select(
        "author_id", "voter_id", "permlink", "rshares",
        F.when(F.col("cancelled"), F.lit(0).cast("long")).otherwise(F.col("followed")).alias("prev_rshares"),
        "source_op")


def cancelled_votes(linked: DataFrame) -> DataFrame:
    """Votes of known voters whose previous vote was cancelled by a removal, with its weight."""
    return _votes(linked).where("cancelled and followed <> 0 and voter_id is not null").select(
        "source_op", F.col("followed").alias("cancelled_rshares"))


def ranked_ops(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with `row_num`: 1 for the newest row of its (author, voter, permlink)."""
    newest_first = F.desc("source_op")

    def whole(part: DataFrame) -> DataFrame:
        return part.select(*ROW, F.row_number().over(
            Window.partitionBy(*POST, "voter_id").orderBy(newest_first)).alias("row_num"))

    posts = hot_posts(rows, hot_rows)
    if posts is None:
        return whole(rows)
    part, rest = split_hot(rows, POST, posts)
    cut = in_runs(part, RUN, hot_rows)
    newer = Window.partitionBy(*CHAIN).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(*CHAIN, "piece").agg(F.count(F.lit(1)).alias("n"))
        .select(*[F.col(c).alias(f"_{c}") for c in [*CHAIN, "piece"]],
                F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("newer"))
    )
    same = F.lit(True)
    for c in [*CHAIN, "piece"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*CHAIN, "piece").orderBy(newest_first))
    sliced = (
        cut.withColumn("inside", inside).join(counts, same)
        .select(*ROW, (F.col("inside") + F.col("newer")).cast("int").alias("row_num"))
    )
    return whole(rest).unionByName(sliced)


def removals(ranked: DataFrame) -> DataFrame:
    """Delete and payout rows."""
    return ranked.where(F.col("kind") == REMOVAL).select("author_id", "permlink", "source_op", "row_num")


def latest_votes(ranked: DataFrame) -> DataFrame:
    """The newest vote of every chain."""
    return ranked.where((F.col("row_num") == 1) & (F.col("kind") == VOTE)).select(
        "author_id", "voter_id", "permlink", "rshares", "source_op")
