"""The ordered reputation step, run in parallel.

Every vote changes its author's reputation under gates that read the author's and the voter's
reputation at that moment, so the result depends on the order of all votes. The log is cut by
operation id into slices of equal length. A slice is folded in order by one task, starting from a
guess of the reputations at its first operation; all slices run at the same time. What a slice adds
to each account, summed over the slices before, gives better starts for the next round. Slices whose
starts could change a decision run again, until none is left.

* The first slice starts from the stored state, so it is right after one round; slice k is right
  once the slices before it are. The loop therefore ends, and it can only end at the sequential
  result.
* Slices are cut by operation, never by account: an author or voter with a third of all votes is
  spread over all slices.
* A fold reports, per account, how far the start may move without any gate deciding differently
  (`slack`). A slice runs again only when a start moves further or an implicit flag changes; the
  sums it reported stay valid otherwise.
* Votes are shuffled once into slices, one slice per task, and kept there. Slices before the first open one
  are final: they become part of the stored state and leave the rounds, so a round shuffles one row per
  open slice and account, and one per account for all that is settled.
"""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votescore.functions.score import scaled
from votescore.operators.waves import in_waves
from votescore.session import cut_lineage, measured

# Votes folded by one task. A round costs more than folding them, so slices are not made shorter to occupy every core.
SLICE_VOTES = 500_000
# Slices that run at the same time. On hostile logs a round settles one slice, and all others of its wave run again: with
# waves of a fixed length the work of a log is in proportion to its votes, and not to their square.
WAVE_SLICES = 4

STORED_SLICE = -1

_FOLDED = (
    "slice int, account_id int, delta decimal(38,0), implicit boolean, "
    "ran_reputation decimal(38,0), ran_implicit boolean, slack decimal(38,0), overflow boolean"
)
_TRACED = (
    "source_op bigint, author_id int, voter_id int, author_reputation bigint, author_implicit boolean, "
    "voter_reputation bigint, voter_implicit boolean, undone boolean, applied boolean"
)


def _slice_folder(trace: bool):
    """Task function: folds one slice of votes, given the start state of its accounts.

    Defined as a closure so that workers receive it whole.
    """

    def fold(votes, starts):
        import pyarrow as pa

        def values(column):
            return column.to_pylist() if column.null_count else column.to_numpy().tolist()

        limit, far = 2**63 - 1, 2**200
        accounts = values(starts["account_id"])
        start = dict(zip(accounts, map(int, starts["start_reputation"].to_pylist())))
        state = dict(start)
        explicit = {a for a, implicit in zip(accounts, starts["start_implicit"].to_pylist()) if not implicit}
        slack, peak, gates = {}, {}, []

        def may_move(account, distance):
            if distance < slack.get(account, far):
                slack[account] = distance

        def exceeds(voter, voter_rep, author, author_rep):
            if voter == author:
                return False  # one account, the same number on both sides, or less on the left
            lead = voter_rep - author_rep
            room = (lead + 1) // 2 if lead > 0 else (2 - lead) // 2
            may_move(voter, room)
            may_move(author, room)
            return lead > 0

        def write(account, reputation):
            state[account] = reputation
            size = reputation if reputation >= 0 else -reputation - 1
            if size > peak.get(account, -1):
                peak[account] = size

        for author, voter, op, weight, previous in zip(
                *(values(votes[c]) for c in ("author_id", "voter_id", "source_op", "weight", "previous"))):
            author_rep, voter_rep = state.get(author, 0), state.get(voter, 0)
            if trace:
                gates.append([op, author, voter, author_rep, author not in explicit,
                              voter_rep, voter not in explicit, False, False])
            if voter_rep < 0:
                may_move(voter, -voter_rep)
                continue
            if voter_rep < slack.get(voter, far):
                slack[voter] = voter_rep + 1
            if author in explicit and (previous >= 0 or (
                    voter in explicit and exceeds(voter, voter_rep, author, author_rep - previous))):
                author_rep -= previous
                write(author, author_rep)
                may_move(author, abs(author_rep) or 1)
                if author_rep == 0:
                    explicit.discard(author)
                if trace:
                    gates[-1][-2] = True
                if voter == author:
                    voter_rep = author_rep
                    if voter_rep < 0:
                        continue
                    may_move(voter, voter_rep + 1)
            if weight is not None and (weight >= 0 or (
                    voter in explicit and exceeds(voter, voter_rep, author, author_rep))):
                write(author, author_rep + weight)
                explicit.add(author)
                if trace:
                    gates[-1][-1] = True

        if trace:
            columns = list(zip(*gates)) or [[]] * 9
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(),
                     pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            names = ["source_op", "author_id", "voter_id", "author_reputation", "author_implicit",
                     "voter_reputation", "voter_implicit", "undone", "applied"]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

        for account, size in peak.items():
            may_move(account, max(limit - size, 0) + 1)
        number = pa.decimal128(38, 0)
        return pa.table({
            "slice": starts["slice"],
            "account_id": starts["account_id"],
            "delta": pa.array([state[a] - start[a] for a in accounts], number),
            "implicit": pa.array([a not in explicit if a in peak else None for a in accounts], pa.bool_()),
            "ran_reputation": starts["start_reputation"].cast(number),
            "ran_implicit": starts["start_implicit"],
            "slack": pa.array([slack.get(a) for a in accounts], number),
            "overflow": pa.array([peak.get(a, 0) > limit for a in accounts], pa.bool_()),
        })

    return fold


def _slices(votes: DataFrame, count: int) -> DataFrame:
    """Votes with their slice number, laid out so that a slice is one sorted run of one partition."""
    weighted = votes.select(
        "source_op", "author_id", "voter_id",
        scaled(F.col("rshares")).alias("weight"), scaled(F.col("prev_rshares")).alias("previous"))
    if count == 1:
        numbered = weighted.withColumn("slice", F.lit(0))
    else:
        # The slice numbers must not change when a lost partition is rebuilt, hence the checkpoint.
        numbered = cut_lineage(
            weighted.repartitionByRange(count, "source_op").withColumn("slice", F.spark_partition_id()))
    return numbered.repartitionById(count, "slice").sortWithinPartitions("source_op").persist(StorageLevel.MEMORY_AND_DISK)


def _first_guess(votes: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per slice and account: as if every upvote counted and no downvote did.

    Voters that are nobody's author and have no stored state stay at the default for good, so they
    need no row; stored accounts that the votes do not touch need none either.
    """
    upvote = F.col("weight") >= 0
    seen = votes.select("slice", F.inline(F.array(
        F.struct(F.col("author_id").alias("account_id"), F.lit(True).alias("holds_state"),
                 F.when(upvote, F.col("weight")).alias("gain")),
        F.struct(F.col("voter_id").alias("account_id"), F.lit(False).alias("holds_state"),
                 F.lit(None).cast("long").alias("gain")),
    ))).where(F.col("account_id").isNotNull())
    rows = seen.groupBy("account_id", "slice").agg(
        F.coalesce(F.sum(F.col("gain").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("delta"),
        F.when(F.count("gain") > 0, F.lit(False)).alias("implicit"),
        F.max("holds_state").alias("holds_state"),
    ).unionByName(stored.select(
        "account_id", F.lit(STORED_SLICE).alias("slice"), F.col("reputation").cast("decimal(38,0)").alias("delta"),
        F.coalesce("is_implicit", F.lit(True)).alias("implicit"), F.lit(True).alias("holds_state"),
    ))
    account = Window.partitionBy("account_id")
    return (
        rows.withColumns({
            "touched": F.max(F.col("slice") != STORED_SLICE).over(account),
            "holds": F.max("holds_state").over(account),
        })
        .where(F.col("touched") & F.col("holds"))
        .select("slice", "account_id", "delta", "implicit",
                F.lit(None).cast("decimal(38,0)").alias("ran_reputation"),
                F.lit(None).cast("boolean").alias("ran_implicit"),
                F.lit(None).cast("decimal(38,0)").alias("slack"), F.lit(False).alias("overflow"))
    )


def _timeline(folded: DataFrame) -> DataFrame:
    """Start of every account in every slice from the sums of the slices before, and whether the
    slice must run again. An account has at most one row per slice."""
    before = (
        Window.partitionBy("account_id").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    with_starts = folded.withColumns({
        "start_reputation": F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("decimal(38,0)"),
        "start_implicit": F.coalesce(F.last("implicit", ignorenulls=True).over(before), F.lit(True)),
    })
    moved = F.abs(F.col("start_reputation") - F.col("ran_reputation")) >= F.col("slack")
    return with_starts.withColumn("dirty", (F.col("slice") != STORED_SLICE) & (
        F.col("ran_reputation").isNull()
        | (F.col("start_implicit") != F.col("ran_implicit"))
        | F.coalesce(moved, F.lit(False))
    ))


def _cogroup(votes: DataFrame, starts: DataFrame, count: int, trace: bool) -> DataFrame:
    """One task per slice; the votes are where they are wanted, the starts come to them."""
    return (
        votes.groupBy("slice").cogroup(starts.repartitionById(count, "slice").groupBy("slice"))
        .applyInArrow(_slice_folder(trace), _TRACED if trace else _FOLDED)
    )


_STARTS = ["slice", "account_id", "start_reputation", "start_implicit"]


def _settled(line: DataFrame, first_open: int) -> DataFrame:
    """The rows of slices before the first open one as one stored row per account."""
    last = F.max(F.when(F.col("implicit").isNotNull(), F.struct("slice", "implicit"))).alias("last")
    return line.where(F.col("slice") < first_open).groupBy("account_id").agg(
        F.sum("delta").cast("decimal(38,0)").alias("delta"), last, F.max("wrote").alias("wrote")
    ).select(
        F.lit(STORED_SLICE).alias("slice"), "account_id", "delta", F.col("last.implicit").alias("implicit"),
        F.lit(None).cast("decimal(38,0)").alias("ran_reputation"), F.lit(None).cast("boolean").alias("ran_implicit"),
        F.lit(None).cast("decimal(38,0)").alias("slack"), F.lit(False).alias("overflow"), "wrote")


def _settle(votes: DataFrame, stored: DataFrame, count: int, keep_starts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Runs rounds until none of the `count` slices needs another one.

    Returns the settled timeline (one row per account), and the starts of all slices if they are to be kept.
    """
    columns = [c.split()[0] for c in _FOLDED.split(", ")] + ["wrote"]
    wrote = (F.col("slice") != STORED_SLICE) & F.col("implicit").isNotNull()
    line = _timeline(_first_guess(votes, stored).withColumn("wrote", wrote))
    if count > 1:  # one slice is short and starts from the stored state: not worth a write
        line = cut_lineage(line)
    rerun, kept = F.col("slice") != STORED_SLICE, None
    while True:
        # Renamed: one slice's line is no checkpoint and still holds the votes' own column.
        starts = line.where(rerun).select(F.col("slice").alias("slice"), *_STARTS[1:])
        fresh = _cogroup(votes.where(rerun), starts, count, trace=False).withColumn("wrote", F.col("implicit").isNotNull())
        line = cut_lineage(_timeline(fresh.unionByName(line.where(~rerun).select(*columns))))
        # At most a few rows per slice of the wave.
        states = line.where("dirty or overflow").select("slice", "dirty", "overflow").distinct().collect()
        again = [r.slice for r in states if r.dirty]
        first_open = min(again, default=count)
        if any(r.overflow for r in states if r.slice < first_open):
            raise ArithmeticError("reputation out of the 64-bit range")
        if keep_starts:
            done = line.where((F.col("slice") != STORED_SLICE) & (F.col("slice") < first_open)).select(*_STARTS)
            kept = done if kept is None else kept.unionByName(done)
        settled = _settled(line, first_open)
        if not again:
            return settled, kept
        line = _timeline(settled.unionByName(line.where(F.col("slice") >= first_open).select(*columns)))
        rerun = F.col("slice").isin(again)


def _changes(line: DataFrame) -> DataFrame:
    """Accounts written by the votes, with their state after them."""
    return line.where("wrote").select(
        "account_id", F.col("delta").cast("long").alias("reputation"), F.col("implicit").alias("is_implicit"))


def _waves(votes: DataFrame, slice_votes: int, slices: int | None, total: int | None = None):
    """Consecutive parts of the votes, each with its slice count. One part unless the log needs more
    than WAVE_SLICES slices; then the parts follow each other."""
    total = votes.count() if total is None else total
    if not total:
        return
    wanted = slices or -(-total // slice_votes)
    yield from in_waves(votes, min(wanted, total), WAVE_SLICES)


def merge_reputation(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored state with the changed accounts replaced or added."""
    old = stored.select("account_id", F.struct("reputation", "is_implicit").alias("old"))
    new = changes.select("account_id", F.struct("reputation", "is_implicit").alias("new"))
    return old.join(new, "account_id", "full_outer").select(
        "account_id", F.coalesce("new", "old").alias("state")
    ).select("account_id", "state.reputation", "state.is_implicit")


def after_wave(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """`merge_reputation` between waves. The next changes are made from it and merged with it, so its size is taken anew."""
    return measured(merge_reputation(stored, changes), "state")


def _no_state(votes: DataFrame) -> DataFrame:
    return votes.sparkSession.createDataFrame([], "account_id int, reputation bigint, is_implicit boolean")


def fold_votes(votes: DataFrame, stored: DataFrame | None = None, slice_votes: int = SLICE_VOTES,
               slices: int | None = None, count_of_votes: int | None = None) -> DataFrame:
    """Reputation changes of the votes (see `vote_transitions`), applied in operation order. They are counted unless
    their number is given.

    Returns (account_id, reputation, is_implicit) of the accounts that were written.
    """
    start = stored if stored is not None else _no_state(votes)
    total = None
    for part, count in _waves(votes, slice_votes, slices, count_of_votes):
        if total is not None:
            start = after_wave(start, changes)
        laid = _slices(part, count)
        changes = cut_lineage(_changes(_settle(laid, start, count)[0]))
        laid.unpersist()
        total = changes if total is None else after_wave(total, changes)
    return total if total is not None else _no_state(votes)


def vote_gates(votes: DataFrame, stored: DataFrame | None = None, slice_votes: int = SLICE_VOTES,
               slices: int | None = None) -> DataFrame:
    """Per vote: author's and voter's state just before it, and whether the previous vote was undone
    and the new one applied."""
    start = stored if stored is not None else _no_state(votes)
    traces = None
    for part, count in _waves(votes, slice_votes, slices):
        laid = _slices(part, count)
        line, starts = _settle(laid, start, count, keep_starts=True)
        trace = cut_lineage(_cogroup(laid, starts, count, trace=True))
        laid.unpersist()
        traces = trace if traces is None else traces.unionByName(trace)
        start = after_wave(start, cut_lineage(_changes(line)))
    return traces if traces is not None else votes.sparkSession.createDataFrame([], _TRACED)
