import glob
import random
import threading
from datetime import datetime

import pytest

from tests.helpers import accounts_frame, active_rows, ops_frame, reputation_rows
from tests.model import Model, random_log, raw_ops
from votescore import schemas
from votescore.fixtures import TYPES
from votescore.operators.active import batch_effects
from votescore.operators.compare import diff_by_digests, expected_diff
from votescore.plans import ranges
from votescore.plans.ranges import catch_up, link_range, process, process_batch
from votescore.plans.scores import committed_diff, committed_score, scores
from votescore.plans.state import REPUTATION, VOTES, StateStore
from votescore.session import scratch_path
from votescore.streaming import live


@pytest.fixture()
def store(spark):
    return StateStore(spark, scratch_path(spark, "test-state")).create()


def state(store):
    return reputation_rows(store.reputation()), active_rows(store.active_votes())


def expected(rows):
    model = Model().run(rows)
    return model.reputation_rows(), model.active_rows()


@pytest.mark.parametrize("seed", [1])
def test_any_split_gives_the_same_state(spark, store, seed):
    rows = random_log(seed, size=200)
    ops, accounts = ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6))
    step = random.Random(seed).randrange(12, 25)
    head = catch_up(store, ops, accounts, TYPES, step=step)
    assert head == rows[-1][0] // 10 + 1
    assert state(store) == expected(rows)
    reputation, active = process(ops, accounts, TYPES)
    assert (reputation_rows(reputation), active_rows(active)) == expected(rows)


def test_block_limit_and_resume(spark, store):
    rows = random_log(3, size=120)
    ops, accounts = ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6))
    assert catch_up(store, ops, accounts, TYPES, step=100, limit_block=9) == 9
    assert state(store) == expected([r for r in rows if r[0] // 10 + 1 <= 9])
    catch_up(store, ops, accounts, TYPES, step=100)
    done = store.latest()
    assert state(store) == expected(rows)
    catch_up(store, ops, accounts, TYPES)  # nothing left
    assert store.latest() == done
    assert StateStore(spark, store.root).create().latest() == done  # an existing store is kept


def test_a_range_reads_its_own_operations(spark, store, monkeypatch):
    """A log of many ranges is laid out once by range; a commit scans one folder of it, and not the log."""
    plans, batch = [], ranges.process_batch

    def seen(store, ops, *others):
        plans.append(ops._jdf.queryExecution().executedPlan().toString())
        return batch(store, ops, *others)

    monkeypatch.setattr(ranges, "process_batch", seen)
    rows = random_log(5, size=200)
    catch_up(store, ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6)), TYPES, step=4)
    assert len(plans) >= 4 and all("PartitionFilters: [isnotnull(range" in plan and "ExistingRDD" not in plan for plan in plans)
    assert reputation_rows(store.reputation()) == Model().run(rows).reputation_rows()


def test_committed_batch_is_skipped_and_order_is_enforced(spark, store):
    rows = random_log(4, size=90)
    accounts = accounts_frame(spark, range(6))
    first, second = ops_frame(spark, raw_ops(rows[:45])), ops_frame(spark, raw_ops(rows[45:]))
    assert process_batch(store, first, accounts, TYPES, "s", 0)
    assert not process_batch(store, first, accounts, TYPES, "s", 0)
    with pytest.raises(ValueError, match="is not after the committed operation"):
        process_batch(store, first, accounts, TYPES, "s", 1)
    assert not process_batch(store, ops_frame(spark, []), accounts, TYPES, "s", 2)
    assert process_batch(store, second, accounts, TYPES, "s", 3)
    assert state(store) == expected(rows)


def test_failed_attempt_leaves_no_trace(spark, store):
    rows = random_log(5, size=60)
    accounts = accounts_frame(spark, range(6))
    broken = StateStore(spark, store.root)
    broken._record = lambda row: (_ for _ in ()).throw(RuntimeError("lost driver"))
    with pytest.raises(RuntimeError):
        process_batch(broken, ops_frame(spark, raw_ops(rows)), accounts, TYPES, "s", 0)
    assert store.latest().version == 0
    assert process_batch(store, ops_frame(spark, raw_ops(rows)), accounts, TYPES, "s", 0)
    assert state(store) == expected(rows)


def test_rewind_twice(spark, store):
    rows = random_log(6, size=120)
    accounts = accounts_frame(spark, range(6))
    top = rows[-1][0] // 10 + 1
    early, middle = top // 2, 3 * top // 4

    def chain(fork, seed):
        """The log up to the fork, then other operations with the same ids."""
        other = [(r[0], r[1], *s[2:]) for r, s in zip(rows, random_log(seed, size=120))]
        return [r if r[0] // 10 + 1 <= fork else o for r, o in zip(rows, other)]

    for fork, seed in ((early, 7), (middle, 8)):
        catch_up(store, ops_frame(spark, raw_ops(chain(fork, seed))), accounts, TYPES, step=early)
        target = store.rewind(fork + 1)
        assert target.last_block <= fork
    catch_up(store, ops_frame(spark, raw_ops(rows)), accounts, TYPES)
    assert state(store) == expected(rows)
    with pytest.raises(ValueError, match="no state before"):
        store.rewind(0)


def test_stream_resumes_and_equals_batch(spark, store):
    rows = random_log(9, size=120)
    accounts = accounts_frame(spark, range(6))
    log, position = scratch_path(spark, "test-log"), scratch_path(spark, "test-position")
    for part in (rows[:100], rows[100:]):
        ops_frame(spark, raw_ops(part)).coalesce(1).write.mode("append").parquet(log)
        live.start(live.read_stream(spark, log), accounts, TYPES, store, position).awaitTermination()
    assert store.latest().last_op == rows[-1][0]
    assert state(store) == expected(rows)
    # Another run without new files, and a redelivery of the last batch, change nothing.
    done = store.latest()
    live.start(live.read_stream(spark, log), accounts, TYPES, store, position).awaitTermination()
    assert not process_batch(store, ops_frame(spark, raw_ops(rows[100:])), accounts, TYPES, position, done.batch_id)
    assert store.latest() == done


def test_stream_block_limit(spark, store):
    rows = random_log(10, size=80)
    log = scratch_path(spark, "test-log")
    ops_frame(spark, raw_ops(rows)).write.parquet(log)
    live.start(live.read_stream(spark, log), accounts_frame(spark, range(6)), TYPES, store,
               scratch_path(spark, "test-position"), limit_block=6).awaitTermination()
    assert state(store) == expected([r for r in rows if r[0] // 10 + 1 <= 6])


def test_progress_record(store):
    row = store.latest()
    assert (row.version, row.last_block, row.pipeline_version) == (0, 0, "0.1.0")
    assert isinstance(row.ended_at, datetime)


def edge(**more):
    return dict(source="s", batch_id=0, first_block=1, last_block=1, last_op=1, started_at=datetime.now()) | more


def test_one_of_two_writers_on_the_same_commit_fails(spark, store):
    active = spark.createDataFrame([], schemas.ACTIVE_VOTES)
    for trial in range(20):
        head = store.latest()
        rows = [spark.createDataFrame([(1, 2 * trial + k, False)], schemas.REPUTATION) for k in range(2)]
        start, outcomes = threading.Barrier(2), []

        def write(k, head=head, rows=rows, start=start, outcomes=outcomes):
            writer = StateStore(spark, store.root)
            commit, record = writer.commit, writer._record
            writer._record = lambda row: (start.wait(), record(row))
            try:
                commit(head, rows[k], active, **edge())
                outcomes.append(k)
            except FileExistsError as e:
                assert "another writer" in str(e)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(outcomes) == 1
        assert store.latest().version == head.version + 1 == max(store.versions())
        assert reputation_rows(store.reputation()) == [(1, 2 * trial + outcomes[0], False)]
    assert store.progress().count() == 21


def test_batch_that_ends_inside_a_block(spark, store):
    rows = random_log(11, size=120)
    ops, accounts = ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6))
    cut = next(i for i in range(60, 120) if (rows[i][0] - 1) // 10 == (rows[i - 1][0] - 1) // 10)
    process_batch(store, ops_frame(spark, raw_ops(rows[:cut])), accounts, TYPES, "part", 0)
    assert state(store) == expected(rows[:cut])
    catch_up(store, ops, accounts, TYPES, step=3)
    assert state(store) == expected(rows)
    # The same hole after a rewind to that commit.
    fork = next(r.last_block for r in store.progress().orderBy("version").collect() if r.source == "part") + 1
    assert store.rewind(fork).last_op == rows[cut - 1][0]
    catch_up(store, ops, accounts, TYPES)
    assert state(store) == expected(rows)


def test_redelivery_after_another_source(spark, store):
    rows = random_log(12, size=90)
    ops, accounts = ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6))
    first = ops_frame(spark, raw_ops(rows[:45]))
    assert process_batch(store, first, accounts, TYPES, "stream", 0)
    catch_up(store, ops, accounts, TYPES)
    done = store.latest()
    assert not process_batch(store, first, accounts, TYPES, "stream", 0)
    assert store.latest() == done and state(store) == expected(rows)


def test_operations_that_cannot_be_used(spark, store):
    rows = random_log(13, size=60)
    good, last = raw_ops(rows), rows[-1][0]
    vote = '{"author": "acct-1", "voter": "%s", "permlink": "post-0", "rshares": %s}'
    bad = [(last + 1, 900, 72, vote[:30]), (last + 2, 900, 17, None), (last + 3, 900, 72, vote % ("nobody", 5)),
           (last + 4, 900, 72, vote % ("acct-2", '"many"'))]
    accounts = accounts_frame(spark, range(6))
    for op in bad:
        with pytest.raises(Exception, match="does not parse|without voter|cannot be cast"):
            process_batch(store, ops_frame(spark, good + [op]), accounts, TYPES, "s", 0)
    assert store.latest().version == 0
    apart, log = scratch_path(spark, "bad"), scratch_path(spark, "bad-log")
    ops_frame(spark, good + bad).coalesce(1).write.parquet(log)
    live.start(live.read_stream(spark, log), accounts, TYPES, store, scratch_path(spark, "bad-position"), bad=apart).awaitTermination()
    assert state(store) == expected(rows)
    assert sorted((r.source_op - last, r.reason) for r in spark.read.parquet(apart + "/v=1").collect()) == [
        (1, "body"), (2, "body"), (3, "voter"), (4, "weight")]


def written(store, snapshot):
    """Rows that a commit wrote, by table."""
    out = {}
    for table in (REPUTATION, VOTES):
        found = glob.glob(f"{local(store.root)}/{table}/{snapshot}*/*/*.parquet")
        out[table] = sum(store.spark.read.parquet(f).count() for f in found)
    return out


def local(path):
    return path.removeprefix("file:")


def test_small_batch_appends_few_rows(spark):
    """One vote against a state of many posts and accounts: it writes one row of either table and reads one bucket."""
    store = StateStore(spark, scratch_path(spark, "test-state"), buckets=16).create()
    rows = [(i + 1, 72, i % 40, (i + 1) % 40, i % 3, 1000 + i) for i in range(400)]
    accounts = accounts_frame(spark, range(40))
    process_batch(store, ops_frame(spark, raw_ops(rows)), accounts, TYPES, "s", 0)
    before = store.latest()
    assert (before.deleted_votes, before.queued_votes) == (0, 400) and before.upserted_votes == store.active_votes().count()
    late = (500, 72, 1, 2, 1, 77)
    process_batch(store, ops_frame(spark, raw_ops([late])), accounts, TYPES, "s", 1)
    after = store.latest()
    assert written(store, after.snapshot) == {REPUTATION: 1, VOTES: 1}
    assert (after.deleted_votes, after.upserted_votes, after.queued_votes) == (0, 1, 1)
    assert sum(after.votes_in[b] != before.votes_in[b] for b in before.votes_in) == 1
    assert sum(after.reputation_in[b] != before.reputation_in[b] for b in before.reputation_in) == 1
    assert state(store) == expected(rows + [late])
    touched = store.touched(store.active_votes().where("author_id = 1 and permlink = 'post-1'"), VOTES, after)
    files = store.active_votes(after, touched).inputFiles()
    assert len(touched) == 1 and all(f"bucket={touched[0]}/" in f for f in files)


def test_appends_are_folded_in(spark):
    """Blocks one by one: a bucket never holds more changes than it may, and removed votes stay removed."""
    store = StateStore(spark, scratch_path(spark, "test-state"), buckets=2, appends=2).create()
    rows = random_log(14, size=90)
    catch_up(store, ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6)), TYPES, step=1)
    head = store.latest()
    assert all(sum(s.endswith(".changes") for s in at) <= 2 for held in (head.reputation_in, head.votes_in) for at in held.values())
    assert head.version > 5 and state(store) == expected(rows)
    counts = store.progress().agg({"queued_votes": "sum"}).first()[0]
    assert counts == sum(r[1] == 72 for r in rows)


def test_counts_of_a_batch(spark, store):
    rows = random_log(15, size=120)
    ops, accounts = ops_frame(spark, raw_ops(rows)), accounts_frame(spark, range(6))
    cut = rows[60][0]
    process_batch(store, ops.where(f"source_op < {cut}"), accounts, TYPES, "s", 0)
    stored = store.active_votes()
    want = batch_effects(link_range(ops.where(f"source_op >= {cut}"), accounts, TYPES, stored)).first()
    process_batch(store, ops.where(f"source_op >= {cut}"), accounts, TYPES, "s", 1)
    assert tuple(store.latest()[c] for c in want.asDict()) == tuple(want) and want.deleted_votes > 0


def test_one_name_reads_one_bucket(spark):
    store = StateStore(spark, scratch_path(spark, "test-state"), buckets=16).create()
    rows = [(i + 1, 72, i % 40, (i + 1) % 40, i % 3, 10**12 + i) for i in range(200)]
    accounts = accounts_frame(spark, range(50))
    process_batch(store, ops_frame(spark, raw_ops(rows)), accounts, TYPES, "s", 0)
    names = spark.createDataFrame([("acct-7",)], "name string")
    found = committed_score(store, names, accounts.selectExpr("cast(id as long) id", "name"))
    assert len([f for f in found.inputFiles() if REPUTATION in f]) == 1
    everyone = {r.name: r.score for r in scores(store.reputation(), accounts).collect()}
    assert [tuple(r) for r in found.collect()] == [("acct-7", everyone["acct-7"])] and everyone["acct-7"] > 25
    assert committed_score(store, accounts.select("name"), accounts).count() == 50
    assert [r.score for r in committed_score(store, spark.createDataFrame([("acct-45",)], "name string"), accounts).collect()] == [0]
    with pytest.raises(Exception, match="does not exist"):
        committed_score(store, spark.createDataFrame([("nobody",)], "name string"), accounts).collect()


def commits(spark, store, first, last):
    active = spark.createDataFrame([], schemas.ACTIVE_VOTES)
    for i in range(first, last + 1):
        store.commit(store.latest(), spark.createDataFrame([(1, i, False)], schemas.REPUTATION), active,
                     **edge(batch_id=i, first_block=i, last_block=i, last_op=i))


def test_old_snapshots_expire(spark, store):
    commits(spark, store, 1, 5)
    assert store.expire(keep=3) == 2
    assert store.versions() == [3, 4, 5]
    assert store.rewind(4).last_block == 3
    assert reputation_rows(store.reputation()) == [(1, 3, False)]
    assert sorted(r.version for r in store.progress().collect()) == list(range(7))


def test_records_do_not_pile_up(spark):
    """However many commits there were, a few whole records are read; older ones are history, and rewinds do not go there."""
    store = StateStore(spark, scratch_path(spark, "test-state"), buckets=1, history=3).create()
    commits(spark, store, 1, 16)
    assert 3 <= len(store.versions()) <= 6
    listed = store.progress().orderBy("version").collect()
    assert [(r.version, r.last_block) for r in listed] == [(i, i) for i in range(17)]
    assert [r.reputation_in is None for r in listed] == [r.version not in store.versions() for r in listed]
    with pytest.raises(ValueError, match="no state before"):
        store.rewind(5)
    stale = StateStore(spark, store.root, history=3)
    with pytest.raises(FileExistsError, match="another writer"):
        stale._record(store.latest().asDict() | {"version": 4})
    assert store.latest().version == 16 and store.rewind(16).last_block == 15
    assert reputation_rows(store.reputation()) == [(1, 15, False)]


def test_a_rewind_reads_no_state(spark, store):
    commits(spark, store, 1, 2)
    store._read = None  # a rewind that looks at rows would fail
    assert store.rewind(2).last_block == 1


def test_one_changed_account_reads_one_bucket(spark):
    store = StateStore(spark, scratch_path(spark, "test-state"), buckets=16).create()
    rows = [(i, 10 * i, False) for i in range(300)]
    state_rows = spark.createDataFrame(rows, schemas.REPUTATION)
    store.commit(store.latest(), state_rows, spark.createDataFrame([], schemas.ACTIVE_VOTES), **edge())
    expected_rows = state_rows.selectExpr("account_id", "if(account_id = 7, 1, reputation) as reputation")
    found = committed_diff(store, expected_rows)
    assert len([f for f in found.inputFiles() if REPUTATION in f]) == 1
    assert [r.account_id for r in found.collect()] == [7]
    assert committed_diff(store, state_rows).collect() == []
    missing = expected_rows.where("account_id <> 9").unionByName(spark.createDataFrame([(999, 1)], "account_id int, reputation long"))
    assert [r.account_id for r in committed_diff(store, missing).collect()] == [7]
    assert sorted(r.account_id for r in committed_diff(store, missing, strict=True).collect()) == [7, 9, 999]


def test_diff_by_digests_equals_the_join(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(5)) for i in range(200) if rng.random() < 0.9]
    right = [(i, v if rng.random() < 0.95 else v + 1) for i, v in left if rng.random() < 0.97] + [(500, None)]
    a, b = (spark.createDataFrame(x, "account_id int, reputation long") for x in (left, right))
    for strict in (False, True):
        want = sorted(r.account_id for r in expected_diff(a, b, strict).collect())
        assert sorted(r.account_id for r in diff_by_digests(a, b, strict, buckets=32).collect()) == want and want
    assert diff_by_digests(a, a.repartition(3), strict=True).collect() == []
