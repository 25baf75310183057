"""Named queries over the test tables, one or more per operator."""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore import fixtures, schemas
from votescore.fixtures import NAMES, TYPES, table
from votescore.functions.bodies import normalize_ops, parse_removals, parse_votes
from votescore.functions.score import THRESHOLDS, scaled, score
from votescore.operators import active, links
from votescore.operators.compare import diff_by_digests, diff_detail, expected_diff
from votescore.operators.dictionary import batch_dictionary, encode, extend_dictionary
from votescore.operators.fixpoint import fold_in_windows, gates_in_windows
from votescore.operators.fold import fold_votes, merge_reputation, vote_gates
from votescore.operators.resolve import account_ids, names_in, resolve_accounts, resolve_ops, unknown_names
from votescore.plans.ranges import catch_up, link_range, process, process_batch
from votescore.plans.scores import account_score, committed_diff, committed_score, scores
from votescore.plans.state import StateStore
from votescore.plans.status import last_block, sync_status, sync_throughput
from votescore.session import cut_lineage, scratch_path
from votescore.sources import oplog
from votescore.sources.dump import load_dump, write_dump
from votescore.streaming import live

TRANSITION = ["author_id", "voter_id", "permlink", "rshares", "prev_rshares", "source_op"]


# --- log, bodies, accounts -------------------------------------------------------------------------


def _mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote operations of the wide log among operations of another type, one per line item."""
    items = table(spark, sf_dir, "lineitem")
    other = items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 1_000_000_000_000).alias("source_op"),
        (F.floor(F.col("l_orderkey") / 10) + 1).cast("int").alias("block_num"),
        F.lit(2).cast("short").alias("op_type_id"),
        F.to_json(F.struct(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"))).alias("body_value"),
    )
    return fixtures.wide_ops(spark, sf_dir).unionByName(other)


def _op_types(log: DataFrame) -> DataFrame:
    """The type table of the types that occur in a log."""
    name = (
        F.when(F.col("op_type_id") == TYPES.vote, NAMES.vote).when(F.col("op_type_id") == TYPES.delete, NAMES.delete)
        .when(F.col("op_type_id") == TYPES.payout, NAMES.payout).otherwise("protocol::transfer_operation")
    )
    return log.select("op_type_id").distinct().select(F.col("op_type_id").alias("id"), name.alias("name"))


def op_range_scan(spark, sf_dir):
    """Written by type, read back by type id and block range (all blocks of the votes)."""
    path = scratch_path(spark, "log")
    oplog.write_ops(_mixed_log(spark, sf_dir), path)
    stored = oplog.read_ops(spark, path)
    types = oplog.op_type_ids(_op_types(stored), NAMES)
    edge = stored.agg(F.min("block_num").alias("first"), F.max("block_num").alias("last")).first()
    return oplog.scan_ops(stored, types, edge.first, edge.last).select("source_op", "block_num", "op_type_id")


def op_type_ids(spark, sf_dir):
    return oplog.op_type_id_array(_op_types(_mixed_log(spark, sf_dir)), NAMES).select("n_ids", "ids_text")


def parsed_ops(spark, sf_dir):
    return normalize_ops(fixtures.dense_ops(spark, sf_dir), TYPES.vote)


def parsed_votes(spark, sf_dir):
    return parse_votes(fixtures.dense_ops(spark, sf_dir).where(F.col("op_type_id") == TYPES.vote))


def parsed_removals(spark, sf_dir):
    return parse_removals(fixtures.wide_ops(spark, sf_dir).where(F.col("op_type_id") != TYPES.vote))


def _solvent_accounts(spark, sf_dir):
    """Accounts of customers without debt, so that some authors and voters are unknown."""
    customer = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return customer.select(F.col("c_custkey").cast("int").alias("id"),
                           F.concat(F.lit("acct-"), F.col("c_custkey").cast("string")).alias("name"))


def _wide_parsed(spark, sf_dir):
    return normalize_ops(fixtures.wide_ops(spark, sf_dir), TYPES.vote)


def account_resolution(spark, sf_dir):
    return resolve_ops(_wide_parsed(spark, sf_dir), _solvent_accounts(spark, sf_dir))


def account_resolution_shuffled(spark, sf_dir):
    """The same join without a broadcast: the way beyond the broadcast limit."""
    return resolve_ops(_wide_parsed(spark, sf_dir), _solvent_accounts(spark, sf_dir), strategy="merge")


def account_name_ids(spark, sf_dir):
    return account_ids(names_in(_wide_parsed(spark, sf_dir)), _solvent_accounts(spark, sf_dir))


def unknown_accounts(spark, sf_dir):
    return unknown_names(names_in(_wide_parsed(spark, sf_dir)), _solvent_accounts(spark, sf_dir))


def account_lookup(spark, sf_dir):
    """Voter names to ids; removals have none and keep a NULL."""
    names = _wide_parsed(spark, sf_dir).select(F.col("voter").alias("name")).distinct()
    return resolve_accounts(names, fixtures.wide_accounts(spark, sf_dir), required=False)


# --- dictionary ------------------------------------------------------------------------------------


def _dictionaries(spark, sf_dir):
    empty = spark.createDataFrame([], schemas.PERMLINKS)
    first = cut_lineage(extend_dictionary(empty, _dense_parsed(spark, sf_dir).select("permlink")))
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("permlink"))
    return first, cut_lineage(extend_dictionary(first, urls))


def permlink_dictionary(spark, sf_dir):
    """Two batches of strings. Per string: whether it kept its id, and whether ids are 1..n in total."""
    first, both = _dictionaries(spark, sf_dir)
    old = first.select("permlink", F.col("permlink_id").alias("old_id"))
    totals = both.agg(
        ((F.count_distinct("permlink_id") == F.count(F.lit(1))) & (F.max("permlink_id") == F.count(F.lit(1))))
        .alias("ids_dense")).first()
    return both.join(old, "permlink", "left").select(
        "permlink", F.col("old_id").isNotNull().alias("was_known"),
        F.coalesce(F.col("old_id") == F.col("permlink_id"), F.lit(True)).alias("id_kept"),
        F.lit(totals.ids_dense).alias("ids_dense"))


def encoded_ops(spark, sf_dir):
    """Operations through the dictionary and back."""
    _, both = _dictionaries(spark, sf_dir)
    coded = encode(_dense_parsed(spark, sf_dir), both)
    return coded.join(both, "permlink_id").select("source_op", "permlink")


def batch_permlinks(spark, sf_dir):
    """Entries of the dictionary for the votes of the second half of the blocks, and how many votes each has."""
    ops = fixtures.dense_ops(spark, sf_dir)
    late = normalize_ops(oplog.scan_ops(ops, TYPES, first_block=_middle(ops) + 1), TYPES.vote).where("is_vote")
    _, both = _dictionaries(spark, sf_dir)
    entries = batch_dictionary(both, late)
    return encode(late, entries).join(entries, "permlink_id").groupBy("permlink").agg(F.count(F.lit(1)).alias("n_votes"))


# --- links -----------------------------------------------------------------------------------------


def _dense_parsed(spark, sf_dir):
    return normalize_ops(fixtures.dense_ops(spark, sf_dir), TYPES.vote)


def _dense_rows(spark, sf_dir):
    return links.link_input(resolve_ops(_dense_parsed(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)))


def _dense_links(spark, sf_dir):
    return link_range(fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir), TYPES)


def _wide_links(spark, sf_dir):
    return link_range(fixtures.wide_ops(spark, sf_dir), fixtures.wide_accounts(spark, sf_dir), TYPES)


def _middle(ops: DataFrame) -> int:
    return ops.agg(F.max("block_num").alias("block")).first().block // 2


def _second_half_links(spark, sf_dir):
    """Second half of the blocks against the votes stored by the first half."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    middle = _middle(ops)
    stored = active.next_active_votes(
        link_range(oplog.scan_ops(ops, TYPES, last_block=middle), accounts, TYPES))
    return link_range(oplog.scan_ops(ops, TYPES, first_block=middle + 1), accounts, TYPES, stored)


def ranked_ops(spark, sf_dir):
    return links.ranked_ops(_dense_rows(spark, sf_dir)).select(
        "author_id", "voter_id", "permlink", "source_op", "row_num")


def ranked_ops_hot(spark, sf_dir):
    """The same ranks with most posts treated as too big for one task."""
    return links.ranked_ops(_dense_rows(spark, sf_dir), hot_rows=10).select(
        "author_id", "voter_id", "permlink", "source_op", "row_num")


def removals(spark, sf_dir):
    return links.removals(links.ranked_ops(_dense_rows(spark, sf_dir)))


def latest_votes(spark, sf_dir):
    return links.latest_votes(links.ranked_ops(_dense_rows(spark, sf_dir)))


def _previous(linked: DataFrame) -> DataFrame:
    votes = linked.where(F.col("kind") == links.VOTE)
    return votes.select("source_op", F.col("back_rshares").alias("prev_rshares"),
                        F.coalesce("back_op", F.lit(0).cast("long")).alias("prev_source_op"))


def previous_vote_in_batch(spark, sf_dir):
    return _previous(_dense_links(spark, sf_dir))


def previous_vote_stored(spark, sf_dir):
    votes = _second_half_links(spark, sf_dir).where(F.col("kind") == links.VOTE)
    return votes.select(
        "source_op", F.coalesce("back_rshares", "stored_rshares", F.lit(0)).alias("prev_rshares"),
        F.coalesce("back_op", F.lit(0).cast("long")).alias("prev_source_op"))


def cancelled_previous(spark, sf_dir):
    """Votes whose previous vote was cancelled by a removal in between."""
    return links.cancelled_votes(_dense_links(spark, sf_dir))


def vote_transitions(spark, sf_dir):
    return links.vote_transitions(_dense_links(spark, sf_dir)).select(*TRANSITION)


def vote_transitions_hot(spark, sf_dir):
    """The same transitions with most posts treated as too big for one task."""
    linked = links.link(_dense_rows(spark, sf_dir), hot_rows=10)
    return links.vote_transitions(linked).select(*TRANSITION)


def vote_transitions_wide(spark, sf_dir):
    return links.vote_transitions(_wide_links(spark, sf_dir)).select(*TRANSITION)


def removed_votes(spark, sf_dir):
    return active.removed_votes(_second_half_links(spark, sf_dir))


def surviving_votes(spark, sf_dir):
    return active.surviving_votes(_second_half_links(spark, sf_dir))


def active_votes(spark, sf_dir):
    return active.next_active_votes(_dense_links(spark, sf_dir))


def active_votes_wide(spark, sf_dir):
    return active.next_active_votes(_wide_links(spark, sf_dir))


def batch_effect_counts(spark, sf_dir):
    return active.batch_effects(_second_half_links(spark, sf_dir))


# --- reputation ------------------------------------------------------------------------------------


def scaled_votes(spark, sf_dir):
    votes = links.vote_transitions(_dense_links(spark, sf_dir))
    return votes.select("source_op", scaled(F.col("rshares")).alias("scaled_rshares"),
                        scaled(F.col("prev_rshares")).alias("scaled_prev_rshares"))


def raw_standing(spark, sf_dir):
    return fold_votes(links.vote_transitions(_dense_links(spark, sf_dir)))


def raw_standing_sliced(spark, sf_dir):
    """The same state from sixteen slices that start from guesses."""
    return fold_votes(links.vote_transitions(_dense_links(spark, sf_dir)), slices=16)


def raw_standing_wide(spark, sf_dir):
    return fold_votes(links.vote_transitions(_wide_links(spark, sf_dir)))


def raw_standing_windows(spark, sf_dir):
    """The same state as a fixpoint over the decisions of all votes, in windows."""
    return fold_in_windows(links.vote_transitions(_dense_links(spark, sf_dir)))


def raw_standing_wide_windows(spark, sf_dir):
    return fold_in_windows(links.vote_transitions(_wide_links(spark, sf_dir)))


def gates_windows(spark, sf_dir):
    """Gates from states that are looked up as of each vote."""
    return gates_in_windows(links.vote_transitions(_dense_links(spark, sf_dir)), pieces=4).select(
        "source_op", "author_reputation", "author_implicit", "voter_reputation", "voter_implicit",
        "undone", "applied")


def gates(spark, sf_dir):
    return vote_gates(links.vote_transitions(_dense_links(spark, sf_dir)), slices=4).select(
        "source_op", "author_reputation", "author_implicit", "voter_reputation", "voter_implicit",
        "undone", "applied")


def _in_two_ranges(spark, sf_dir) -> StateStore:
    ops = fixtures.dense_ops(spark, sf_dir)
    store = StateStore(spark, scratch_path(spark, "state")).create()
    catch_up(store, ops, fixtures.dense_accounts(spark, sf_dir), TYPES, step=_middle(ops) + 1)
    return store


def raw_standing_incremental(spark, sf_dir):
    return _in_two_ranges(spark, sf_dir).reputation()


def active_votes_incremental(spark, sf_dir):
    return _in_two_ranges(spark, sf_dir).active_votes()


def merged_reputation(spark, sf_dir):
    """State update: balances of all customers, replaced where a customer has orders."""
    old = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("account_id"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("reputation"), F.lit(True).alias("is_implicit"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("int").alias("account_id")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("reputation")
    ).withColumn("is_implicit", F.lit(False))
    return merge_reputation(old, new)


def scores_all(spark, sf_dir):
    return scores(raw_standing(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir))


def scores_wide(spark, sf_dir):
    return scores(raw_standing_wide(spark, sf_dir), fixtures.wide_accounts(spark, sf_dir))


def account_scores(spark, sf_dir):
    """Scores of the accounts that stand as authors in the log."""
    names = _dense_parsed(spark, sf_dir).select(F.col("author").alias("name"))
    return account_score(names, raw_standing(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir))


def committed_scores(spark, sf_dir):
    """Scores of the authors in the log, from the buckets of a committed state that hold them."""
    names = _dense_parsed(spark, sf_dir).select(F.col("author").alias("name"))
    return committed_score(_in_two_ranges(spark, sf_dir), names, fixtures.dense_accounts(spark, sf_dir))


def score_thresholds(spark, sf_dir):
    """Values at a threshold and one beside it, of both signs, zeros and NULLs: one per order."""
    key = F.col("o_orderkey")
    step = F.element_at(F.array(*map(F.lit, THRESHOLDS)), (key % len(THRESHOLDS) + 1).cast("int"))
    value = (step + F.col("o_custkey") % 3 - 1) * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderstatus") != "O", F.lit(0).cast("long"))) \
        .otherwise(value)
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("reputation")).withColumn(
        "score", score(F.col("reputation")))


def score_values(spark, sf_dir):
    """Scores of order prices scaled over twelve powers of ten."""
    power = F.element_at(F.array(*[F.lit(10**k) for k in range(12)]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    value = F.round(F.col("o_totalprice") * 100).cast("long") / 100
    raw = (F.floor(value).cast("long") * power) * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", score(raw).alias("score"))


# --- comparison ------------------------------------------------------------------------------------


def _expected_and_current(spark, sf_dir):
    """Expected values through a dump on disk, current values from the balances. Each side lacks
    some accounts, and some of the shared ones differ."""
    customer = table(spark, sf_dir, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    account_id = F.col("c_custkey").cast("int").alias("account_id")
    accounts = fixtures.wide_accounts(spark, sf_dir)
    moved = F.when(F.col("c_mktsegment") == "BUILDING", F.col("cents")).otherwise(F.col("cents") + F.col("c_nationkey"))
    path = scratch_path(spark, "dump")
    write_dump(customer.where(F.col("c_mktsegment") != "MACHINERY").select(account_id, moved.alias("reputation")),
               accounts, path, rows_per_document=500)
    current = customer.where(F.col("c_acctbal") >= 0).select(account_id, F.col("cents").alias("reputation"))
    return load_dump(spark, path, accounts), current


def expected_values(spark, sf_dir):
    return _expected_and_current(spark, sf_dir)[0]


def differing_accounts(spark, sf_dir):
    return expected_diff(*_expected_and_current(spark, sf_dir))


def differing_accounts_strict(spark, sf_dir):
    return expected_diff(*_expected_and_current(spark, sf_dir), strict=True)


def differing_accounts_by_digests(spark, sf_dir):
    """The same accounts; rows are joined of buckets that differ only."""
    return diff_by_digests(*_expected_and_current(spark, sf_dir), strict=True)


def committed_differences(spark, sf_dir):
    """A committed state of the log against the state of the log without its last tenth."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    top = ops.agg(F.max("block_num").alias("block")).first().block
    part = oplog.scan_ops(ops, TYPES, last_block=top - top // 10)
    return committed_diff(_in_two_ranges(spark, sf_dir), process(part, accounts, TYPES)[0])


def differing_details(spark, sf_dir):
    expected, current = _expected_and_current(spark, sf_dir)
    return diff_detail(expected, current, expected_diff(expected, current, strict=True))


# --- progress --------------------------------------------------------------------------------------


def _progress(spark, sf_dir):
    """One record per hundred blocks, timed by the events in them."""
    block = (F.floor(F.col("event_id") / 10) + 1).cast("int")
    time = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").withColumn("block_num", block)
    return events.groupBy(F.floor((F.col("block_num") - 1) / 100).alias("version")).agg(
        F.min("block_num").alias("first_block"), F.max("block_num").alias("last_block"),
        F.min(time).alias("started_at"), F.max(time).alias("ended_at"))


def last_synced_block(spark, sf_dir):
    return last_block(_progress(spark, sf_dir))


def throughput(spark, sf_dir):
    return sync_throughput(_progress(spark, sf_dir))


def status(spark, sf_dir):
    """Half a minute after the last event, one block behind the head."""
    progress = _progress(spark, sf_dir)
    edge = progress.agg(F.max("last_block").alias("block"), F.min("started_at").alias("start"),
                        F.max("ended_at").alias("end")).first()
    return sync_status(progress, edge.block + 1, edge.start, edge.end + timedelta(seconds=30)).select(
        "last_block", "caught_up", "active", "healthy")


# --- streams and rewind ----------------------------------------------------------------------------


def _streamed(spark, sf_dir) -> StateStore:
    """The log arrives in two appends; the stream takes each and stops, and resumes in between."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    log, position = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-position")
    store = StateStore(spark, scratch_path(spark, "state")).create()
    middle = _middle(ops)
    for part in (ops.where(F.col("block_num") <= middle), ops.where(F.col("block_num") > middle)):
        part.write.mode("append").parquet(log)
        live.start(live.read_stream(spark, log), accounts, TYPES, store, position).awaitTermination()
    return store


def live_standing(spark, sf_dir):
    """The log lies there in four files; the stream takes one at a time, with an interval, until there are no more."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    log = scratch_path(spark, "live-log")
    top = ops.agg(F.max("block_num").alias("block")).first().block
    for i in range(4):
        part = ops.where(F.col("block_num").between(top * i // 4 + 1, top * (i + 1) // 4))
        # One file, but the scan and the bodies before it in parallel.
        part.repartition(1).write.mode("append").parquet(log)
    store = StateStore(spark, scratch_path(spark, "state")).create()
    query = live.start(live.read_stream(spark, log, max_files=1), accounts, TYPES, store,
                       scratch_path(spark, "live-position"), interval="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return store.reputation()


def resumed_standing(spark, sf_dir):
    """A batch ends inside a block; the rest of the block comes with the next range, also after a rewind."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    store = StateStore(spark, scratch_path(spark, "state")).create()
    top = ops.agg(F.max("source_op").alias("op")).first().op
    inside = top // 20 * 10 + 5  # blocks hold ten operations
    process_batch(store, ops.where(F.col("source_op") <= inside), accounts, TYPES, "part", 0)
    catch_up(store, ops, accounts, TYPES)
    store.rewind(store.latest().last_block)
    catch_up(store, ops, accounts, TYPES)
    return store.reputation()


def block_limited_standing(spark, sf_dir):
    """Processing stops at the middle block."""
    ops = fixtures.dense_ops(spark, sf_dir)
    store = StateStore(spark, scratch_path(spark, "state")).create()
    catch_up(store, ops, fixtures.dense_accounts(spark, sf_dir), TYPES, limit_block=_middle(ops))
    return store.reputation()


def committed_ranges(spark, sf_dir):
    """Progress of the store itself: blocks of each commit of a catch-up in four ranges."""
    ops = fixtures.dense_ops(spark, sf_dir)
    store = StateStore(spark, scratch_path(spark, "state")).create()
    top = ops.agg(F.max("block_num").alias("block")).first().block
    catch_up(store, ops, fixtures.dense_accounts(spark, sf_dir), TYPES, step=-(-top // 4))
    return store.progress().where("version > 0").select(
        "version", "first_block", "last_block", "last_op", "deleted_votes", "upserted_votes", "queued_votes")


def stored_accounts(spark, sf_dir):
    """Accounts written and read back by the source."""
    path = scratch_path(spark, "accounts")
    _solvent_accounts(spark, sf_dir).write.parquet(path)
    return oplog.load_accounts(spark, path)


def block_window_scan(spark, sf_dir):
    """A tenth of the blocks of a stored log."""
    path = scratch_path(spark, "log")
    oplog.write_ops(fixtures.wide_ops(spark, sf_dir), path)
    stored = oplog.read_ops(spark, path)
    top = stored.agg(F.max("block_num").alias("block")).first().block
    return oplog.scan_ops(stored, TYPES, top // 2, top // 2 + top // 10).select("source_op", "block_num", "op_type_id")


def stream_standing(spark, sf_dir):
    return _streamed(spark, sf_dir).reputation()


def stream_active_votes(spark, sf_dir):
    return _streamed(spark, sf_dir).active_votes()


def rewound_standing(spark, sf_dir):
    """The last quarter of the blocks is first processed without its removals, then orphaned and
    replayed as it is in the log."""
    ops, accounts = fixtures.dense_ops(spark, sf_dir), fixtures.dense_accounts(spark, sf_dir)
    top = ops.agg(F.max("block_num").alias("block")).first().block
    fork = top * 3 // 4 + 1
    orphaned = ops.where((F.col("block_num") < fork) | (F.col("op_type_id") == TYPES.vote))
    store = StateStore(spark, scratch_path(spark, "state")).create()
    process_batch(store, orphaned, accounts, TYPES, "orphaned", 0, 1, fork - 1)
    process_batch(store, orphaned, accounts, TYPES, "orphaned", 1, fork, top)
    store.rewind(fork)
    catch_up(store, ops, accounts, TYPES)
    return store.reputation()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op_range_scan": op_range_scan,
    "op_type_ids": op_type_ids,
    "parsed_ops": parsed_ops,
    "parsed_votes": parsed_votes,
    "parsed_removals": parsed_removals,
    "account_resolution": account_resolution,
    "account_resolution_shuffled": account_resolution_shuffled,
    "account_name_ids": account_name_ids,
    "unknown_accounts": unknown_accounts,
    "account_lookup": account_lookup,
    "permlink_dictionary": permlink_dictionary,
    "encoded_ops": encoded_ops,
    "ranked_ops": ranked_ops,
    "ranked_ops_hot": ranked_ops_hot,
    "removals": removals,
    "latest_votes": latest_votes,
    "previous_vote_in_batch": previous_vote_in_batch,
    "previous_vote_stored": previous_vote_stored,
    "cancelled_previous": cancelled_previous,
    "vote_transitions": vote_transitions,
    "vote_transitions_hot": vote_transitions_hot,
    "vote_transitions_wide": vote_transitions_wide,
    "removed_votes": removed_votes,
    "surviving_votes": surviving_votes,
    "active_votes": active_votes,
    "active_votes_wide": active_votes_wide,
    "active_votes_incremental": active_votes_incremental,
    "batch_effect_counts": batch_effect_counts,
    "scaled_votes": scaled_votes,
    "raw_standing": raw_standing,
    "raw_standing_sliced": raw_standing_sliced,
    "raw_standing_wide": raw_standing_wide,
    "raw_standing_incremental": raw_standing_incremental,
    "merged_reputation": merged_reputation,
    "vote_gates": gates,
    "raw_standing_windows": raw_standing_windows,
    "raw_standing_wide_windows": raw_standing_wide_windows,
    "vote_gates_windows": gates_windows,
    "scores": scores_all,
    "scores_wide": scores_wide,
    "account_score": account_scores,
    "score_thresholds": score_thresholds,
    "score_values": score_values,
    "expected_values": expected_values,
    "expected_diff": differing_accounts,
    "expected_diff_strict": differing_accounts_strict,
    "diff_detail": differing_details,
    "expected_diff_digests": differing_accounts_by_digests,
    "committed_diff": committed_differences,
    "committed_account_score": committed_scores,
    "last_block": last_synced_block,
    "sync_throughput": throughput,
    "sync_status": status,
    "stream_standing": stream_standing,
    "stream_active_votes": stream_active_votes,
    "rewound_standing": rewound_standing,
    "live_standing": live_standing,
    "resumed_standing": resumed_standing,
    "block_limited_standing": block_limited_standing,
    "committed_ranges": committed_ranges,
    "stored_accounts": stored_accounts,
    "block_window_scan": block_window_scan,
    "batch_permlinks": batch_permlinks,
}
