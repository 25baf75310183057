import random
import re

import pytest

from tests.helpers import VOTES, reputation_rows, size_digits, sorted_rows
from tests.model import Model, random_log
from votescore.operators import fold
from votescore.operators.fold import fold_votes, merge_reputation, vote_gates
from votescore.operators.waves import in_waves


def votes_frame(spark, model):
    return spark.createDataFrame([(a, v, w, p, op) for a, v, _, w, p, op in model.transitions], VOTES)


def one_by_one(spark, *votes):
    """(author, voter, weight, previous) in order, folded in slices of one vote."""
    frame = spark.createDataFrame([(*v, i + 1) for i, v in enumerate(votes)], VOTES)
    return {r.account_id: (r.reputation, r.is_implicit) for r in fold_votes(frame, slices=len(votes)).collect()}


@pytest.mark.parametrize("seed,slices", [(1, 1), (2, 3), (3, 16)])
def test_any_slicing_equals_the_sequential_result(spark, seed, slices):
    model = Model().run(random_log(seed))
    assert reputation_rows(fold_votes(votes_frame(spark, model), slices=slices)) == model.reputation_rows()


def test_hot_author_and_voter(spark):
    model = Model().run(random_log(11, size=600, accounts=20, hot=0.6))
    assert reputation_rows(fold_votes(votes_frame(spark, model), slices=9)) == model.reputation_rows()


@pytest.mark.parametrize("seed", range(20, 21))
def test_continues_from_stored_state(spark, seed):
    rows = random_log(seed, size=200)
    cut = random.Random(seed).randrange(1, len(rows))
    first, full = Model().run(rows[:cut]), Model().run(rows)
    votes = votes_frame(spark, full)
    edge = rows[cut][0]
    stored = fold_votes(votes.where(f"source_op < {edge}"), slices=2)
    assert reputation_rows(stored) == first.reputation_rows()
    changes = fold_votes(votes.where(f"source_op >= {edge}"), stored, slices=4)
    assert reputation_rows(merge_reputation(stored, changes)) == full.reputation_rows()


def test_waves_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(fold, "WAVE_SLICES", 3)
    model = Model().run(random_log(31, size=250))
    assert reputation_rows(fold_votes(votes_frame(spark, model), slices=6)) == model.reputation_rows()
    gates = sorted_rows(vote_gates(votes_frame(spark, model), slices=6), "source_op", "undone", "applied")
    assert gates == model.gates


def test_a_round_is_bounded_for_any_log(spark):
    """A log of twenty slices is folded a few slices at a time, so no round runs over all that is left of it."""
    model = Model().run(random_log(33, size=260))
    votes = votes_frame(spark, model)
    length = -(-votes.count() // 20)
    counts = [count for _, count in fold._waves(votes, length, None)]
    assert len(counts) >= 5 and max(counts) <= 4
    assert reputation_rows(fold_votes(votes, slice_votes=length)) == model.reputation_rows()


def test_a_wave_reads_its_own_votes(spark):
    votes = votes_frame(spark, Model().run(random_log(32, size=300)))
    parts = [part for part, count in in_waves(votes, 9, 3) if count == 3]
    ops = [sorted(r.source_op for r in part.select("source_op").collect()) for part in parts]
    assert len(parts) == 3 and all(ops) and all(a[-1] < b[0] for a, b in zip(ops, ops[1:]))
    assert sum(ops, []) == sorted(r.source_op for r in votes.collect())
    # Files that the plan lists after pruning: those of one folder for each wave.
    scans = [re.search(r"PartitionFilters: \[(.*?)\]", p._jdf.queryExecution().executedPlan().toString()).group(1) for p in parts]
    assert all(f"= {k})" in scan for k, scan in enumerate(scans)), scans


@pytest.mark.parametrize("slices", [4])
def test_gates_per_vote(spark, slices):
    model = Model().run(random_log(41))
    gates = sorted_rows(vote_gates(votes_frame(spark, model), slices=slices), "source_op", "undone", "applied")
    assert gates == model.gates


def test_no_votes(spark):
    empty = spark.createDataFrame([], VOTES)
    assert fold_votes(empty).collect() == []
    assert vote_gates(empty).collect() == []


def test_shift_floors_below_zero(spark):
    # Account 1 earns 1000, then downvotes account 2 with -65 (two units) and -1 (one unit).
    assert one_by_one(spark, (1, 3, 64000, 0), (2, 3, 64, 0), (2, 1, -65, 0), (2, 1, -1, 0))[2] == (1 - 2 - 1, False)


def test_voter_without_reputation_cannot_downvote(spark):
    assert one_by_one(spark, (1, 2, 6400, 0), (1, 3, -6400, 0)) == {1: (100, False)}


def test_downvote_at_equal_reputation_is_refused(spark):
    assert one_by_one(spark, (1, 3, 6400, 0), (2, 3, 6400, 0), (2, 1, -64, 0))[2] == (100, False)


def test_self_upvote_counts_and_self_downvote_never(spark):
    assert one_by_one(spark, (1, 1, 6400, 0), (1, 1, -64, 6400)) == {1: (0, True)}


def test_first_vote_at_zero_makes_author_implicit_again(spark):
    # The author returns to exactly 0; a later refused downvote still clears the explicit flag.
    up, back_to_zero = (1, 9, 6400, 0), (1, 9, 0, 6400)
    assert one_by_one(spark, up, back_to_zero)[1] == (0, False)
    assert one_by_one(spark, up, back_to_zero, (1, 8, -64, 0))[1] == (0, True)


def test_negative_voter_is_ignored(spark):
    votes = [(1, 9, 64000, 0), (2, 9, 64, 0), (2, 1, -6400, 0), (3, 2, 6400, 0)]
    state = one_by_one(spark, *votes)
    assert state[2] == (-99, False) and 3 not in state


def test_unknown_voter_and_missing_weight(spark):
    # An unknown voter counts as (0, implicit). A vote without weight only undoes the previous one.
    assert one_by_one(spark, (1, None, 6400, 0), (1, None, -64, 0)) == {1: (100, False)}
    assert one_by_one(spark, (1, 2, 6400, 0), (1, 2, None, 6400)) == {1: (0, True)}


def test_leaving_the_long_range_is_an_error(spark):
    top = 2**63 - 1
    votes = [(1, 2, top, 0)] * 65
    frame = spark.createDataFrame([(*v, i + 1) for i, v in enumerate(votes)], VOTES)
    with pytest.raises(ArithmeticError):
        fold_votes(frame, slices=4)
    inside = frame.where("source_op <= 64")
    assert reputation_rows(fold_votes(inside, slices=4)) == [(1, 64 * (top >> 6), False)]


@pytest.mark.parametrize("slices", [2, 16])
def test_rounds_do_not_shuffle_votes(spark, slices):
    votes = votes_frame(spark, Model().run(random_log(51)))
    laid = fold._slices(votes, slices)
    laid.count()
    line = fold._timeline(fold._first_guess(laid, fold._no_state(votes))).checkpoint()
    plan = fold._cogroup(laid, line.where("slice <> -1"), slices, trace=False)._jdf.queryExecution().executedPlan().toString()
    dealt = {re.search(r"slice#\d+", text).group() for text in plan.splitlines() if "Exchange" in text}
    # The votes when they were laid out, and the starts of this round; nothing is dealt out again for the fold itself.
    assert len(dealt) == 2 and "ENSURE_REQUIREMENTS" not in plan, plan
    laid.unpersist()


def test_one_slice_per_task(spark):
    votes = votes_frame(spark, Model().run(random_log(52)))
    laid = fold._slices(votes, 12)
    held = laid.groupBy(fold.F.spark_partition_id().alias("part")).agg(fold.F.count_distinct("slice").alias("n")).collect()
    assert len(held) == 12 and all(r.n == 1 for r in held)
    laid.unpersist()


def test_estimated_sizes_do_not_grow_with_the_waves(spark, monkeypatch):
    """They are numbers of any length, held by the driver; each wave doubled their digits."""
    monkeypatch.setattr(fold, "WAVE_SLICES", 1)
    held, settle = [], fold._settle
    monkeypatch.setattr(fold, "_settle", lambda votes, state, *given, **kept: held.append(size_digits(state)) or settle(votes, state, *given, **kept))
    model = Model().run(random_log(81, size=250))
    votes = votes_frame(spark, model)
    changes = fold_votes(votes, slices=5)
    assert reputation_rows(changes) == model.reputation_rows()
    assert sorted_rows(vote_gates(votes, slices=5), "source_op", "undone", "applied") == model.gates
    assert len(held) > 8 and max(held) < 100 and size_digits(changes) < 100
