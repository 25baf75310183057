"""Processing block ranges against the stored state."""

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from votescore.functions.bodies import broken_bodies, normalize_ops, whole_bodies
from votescore.operators.active import effects, next_active_votes, quarantine, vote_changes
from votescore.operators.fold import SLICE_VOTES, fold_votes, merge_reputation
from votescore.operators.links import POST, VOTE, link, link_input, vote_transitions, with_stored
from votescore.operators.resolve import resolve_ops
from votescore.operators.skew import HOT_ROWS
from votescore.plans.state import NO_EFFECT, REPUTATION, VOTES, StateStore
from votescore.session import counted, cut_lineage, scratch_path
from votescore.sources.oplog import OpTypes, scan_ops

CATCH_UP_BLOCKS = 10_000
# Ranges from which a log is laid out by range before they are processed.
MANY_RANGES = 4
RANGES = "ranges"


def resolved_range(ops: DataFrame, accounts: DataFrame, types: OpTypes, bad: str | None = None) -> DataFrame:
    """Resolved operations of a range; JSON is parsed once.

    A body that does not parse, and a vote that would have to be stored without a known voter or without a weight,
    is an error. With a path `bad` such operations are left out and written there as (source_op, reason).
    """
    if bad is None:
        return resolve_ops(normalize_ops(ops, types.vote), accounts)
    resolved = cut_lineage(resolve_ops(normalize_ops(whole_bodies(ops), types.vote, bad_weights=True), accounts))
    usable, unusable = quarantine(resolved)
    reasons = unusable.select("source_op", F.when(F.col("voter_id").isNull(), "voter").otherwise("weight").alias("reason"))
    broken = broken_bodies(ops).select("source_op", F.lit("body").alias("reason"))
    reasons.unionByName(broken).write.mode("overwrite").parquet(bad)
    return usable


def link_range(ops: DataFrame, accounts: DataFrame, types: OpTypes, active_votes: DataFrame | None = None,
               hot_rows: int = HOT_ROWS, bad: str | None = None) -> DataFrame:
    """Linked rows of a range of raw operations. The links are written once and feed both the next active votes and
    the reputation step."""
    rows, figures = counted(link_input(resolved_range(ops, accounts, types, bad), active_votes))
    return cut_lineage(link(rows, hot_rows, figures["n"]))


def process(ops: DataFrame, accounts: DataFrame, types: OpTypes, active_votes: DataFrame | None = None,
            reputation: DataFrame | None = None, hot_rows: int = HOT_ROWS, slice_votes: int = SLICE_VOTES,
            bad: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reputation, active votes) after the operations, from the state before them."""
    linked = link_range(ops, accounts, types, active_votes, hot_rows, bad)
    changes = fold_votes(vote_transitions(linked), reputation, slice_votes)
    after = merge_reputation(reputation, changes) if reputation is not None else changes
    return after, next_active_votes(linked)


def _buckets(found: list[int] | None) -> list[int]:
    return sorted(b for b in found or [] if b is not None)


def _changed_parts(store: StateStore, head: Row, rows: DataFrame, vote_buckets: list[int]) -> dict:
    """What a commit appends, and the counts of its effect. Of the stored votes only those of the posts in the batch
    are linked, and only buckets with such posts or accounts are read. All figures come with the rows themselves."""
    posts, stored = rows.select(*POST).distinct(), store.active_votes(head, vote_buckets)
    joined, figures = counted(with_stored(rows, stored.join(posts, POST, "left_semi")))
    account = lambda c: F.when(F.col("kind") == VOTE, store.bucket_of(REPUTATION, head, c))
    linked, seen = counted(link(joined, known_rows=figures["n"]), *effects(),
                            F.collect_set(account("author_id")).alias("authors"), F.collect_set(account("voter_id")).alias("voters"))
    known = store.reputation(head, _buckets([*(seen["authors"] or []), *(seen["voters"] or [])]))
    changes = fold_votes(vote_transitions(linked), known, count_of_votes=seen["queued_votes"])
    return dict(reputation=changes.withColumn("gone", F.lit(False)), active_votes=vote_changes(linked),
                effect={name: seen[name] for name in NO_EFFECT})


def process_batch(store: StateStore, ops: DataFrame, accounts: DataFrame, types: OpTypes, source: str,
                  batch_id: int, first_block: int | None = None, last_block: int | None = None,
                  bad: str | None = None) -> bool:
    """Applies one batch of operations and commits it; False when this batch was committed before.

    Without given blocks the batch covers the blocks of its operations; an empty one commits nothing. Operations
    that cannot be used are an error, or are kept apart below the path `bad`, in a folder per commit.
    """
    head = store.latest()
    if batch_id <= head.batches.get(source, -1):
        return False
    started = datetime.now()
    metrics = [F.min("source_op").alias("first_op"), F.max("source_op").alias("last_op"),
               F.min("block_num").alias("first_block"), F.max("block_num").alias("last_block")]
    batch, edges = scan_ops(ops, types, first_block, last_block), Observation()
    resolved = resolved_range(batch.observe(edges, *metrics), accounts, types, bad and f"{bad.rstrip('/')}/v={head.version + 1}")
    rows, figures = counted(link_input(resolved), F.collect_set(store.bucket_of(VOTES, head)).alias("buckets"))
    # The planner drops a batch that it knows to be empty, and what was to be observed of it.
    edge = edges.get if figures["n"] else batch.agg(*metrics).first().asDict()
    if edge["last_op"] is None and last_block is None:
        return False
    if edge["first_op"] is not None and edge["first_op"] <= head.last_op:
        raise ValueError(f"operation {edge['first_op']} is not after the committed operation {head.last_op}")
    store.append(
        head, **_changed_parts(store, head, rows, _buckets(figures["buckets"])), source=source, batch_id=batch_id, started_at=started,
        last_op=edge["last_op"] or head.last_op,
        first_block=first_block if first_block is not None else edge["first_block"],
        last_block=last_block if last_block is not None else edge["last_block"])
    return True


def block_ranges(first: int, last: int, step: int = CATCH_UP_BLOCKS) -> Iterator[tuple[int, int]]:
    for start in range(first, last + 1, step):
        yield start, min(start + step - 1, last)


def _by_range(ops: DataFrame, first: int, step: int) -> DataFrame:
    """The operations, written once with a folder for each range of `step` blocks (column `range`), so that a commit reads its
    own operations and not those of all ranges. Files hold ranges of blocks, hence a task writes to few folders."""
    path = scratch_path(ops.sparkSession, "ranges")
    number = F.floor((F.col("block_num") - first) / step).cast("int")
    ops.repartitionByRange("block_num").withColumn("range", number).write.partitionBy("range").parquet(path)
    return ops.sparkSession.read.parquet(path)


def catch_up(store: StateStore, ops: DataFrame, accounts: DataFrame, types: OpTypes,
             step: int = CATCH_UP_BLOCKS, limit_block: int | None = None, bad: str | None = None) -> int:
    """Processes the log after the last committed operation, `step` blocks per commit, up to the head
    of the log or the block limit. Returns the last block.

    A batch may have ended inside a block, so the last committed block is looked at again for what it still holds.
    The result does not depend on `step`; a step should hold enough votes to keep the cluster busy.
    """
    done = store.latest()
    # Only blocks from the last committed one on are looked at, so old files are skipped by their statistics.
    rest = scan_ops(ops, types, done.last_block, limit_block).where(F.col("source_op") > done.last_op)
    edge = rest.agg(F.min("block_num").alias("first"), F.max("block_num").alias("last")).first()
    if edge.last is None:
        return done.last_block
    start = min(edge.first, done.last_block + 1)
    ranges = list(block_ranges(start, edge.last, step))
    laid = _by_range(rest, start, step) if len(ranges) >= MANY_RANGES else None
    for number, (first, last) in enumerate(ranges):
        part = rest if laid is None else laid.where(F.col("range") == number).drop("range")
        process_batch(store, part, accounts, types, RANGES, store.latest().version + 1, first, last, bad)
    return store.latest().last_block
