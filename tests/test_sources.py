import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import accounts_frame, ops_frame, sorted_rows
from tests.model import random_log, raw_ops
from votescore import schemas
from votescore.fixtures import NAMES, TYPES
from votescore.functions.bodies import broken_bodies, normalize_ops, parse_removals, parse_votes, whole_bodies
from votescore.operators.compare import diff_detail, expected_diff
from votescore.operators.dictionary import batch_dictionary, encode, extend_dictionary
from votescore.operators.resolve import resolve_accounts, resolve_ops
from votescore.operators.active import quarantine
from votescore.plans.status import sync_status, sync_throughput
from votescore.session import scratch_path
from votescore.sources import oplog
from votescore.sources.dump import load_dump, write_dump


def type_table(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in names], "id short, name string")


ALL_TYPES = [(72, "protocol::effective_comment_vote_operation"), (17, "protocol::delete_comment_operation"),
             (61, "protocol::comment_payout_update_operation"), (2, "protocol::transfer_operation")]


def test_op_types(spark):
    assert oplog.op_type_ids(type_table(spark, *ALL_TYPES), NAMES) == TYPES
    row = oplog.op_type_id_array(type_table(spark, *ALL_TYPES), NAMES).first()
    assert (list(row.ids), row.n_ids, row.ids_text) == ([17, 61, 72], 3, "17,61,72")
    with pytest.raises(ValueError, match="comment_payout_update"):
        oplog.op_type_ids(type_table(spark, *ALL_TYPES[:2]), NAMES)


def test_types_of_other_namespaces(spark):
    """The whole name counts: the same last part under other prefixes is another type."""
    others = [(90 + i, f"{space}::effective_comment_vote_operation") for i, space in enumerate(("old", "x::protocol", "test", "a"))]
    assert oplog.op_type_ids(type_table(spark, *others, *ALL_TYPES), NAMES) == TYPES
    with pytest.raises(ValueError, match="not unique"):
        oplog.op_type_ids(type_table(spark, (91, NAMES.vote), *ALL_TYPES), NAMES)


def test_scan_prunes_types_and_blocks(spark):
    path = scratch_path(spark, "test-log")
    ops = ops_frame(spark, raw_ops(random_log(1)) + [(5000, 1, 2, "{}")])
    oplog.write_ops(ops, path, files=4)
    scan = oplog.scan_ops(oplog.read_ops(spark, path), TYPES, 3, 7).select("source_op", "body_value")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [op_type_id" in plan
    assert "GreaterThanOrEqual(block_num,3), LessThanOrEqual(block_num,7)" in plan
    assert "ReadSchema: struct<source_op:bigint,block_num:int,body_value:string>" in plan
    want = ops.where("op_type_id <> 2 and block_num between 3 and 7")
    assert sorted_rows(scan, "source_op") == sorted_rows(want, "source_op")


def bodies(spark, *bodies_):
    return ops_frame(spark, [(i + 1, 1, kind, json.dumps(body)) for i, (kind, body) in enumerate(bodies_)])


def test_bodies(spark):
    vote = {"author": "a", "voter": "v", "permlink": "p", "rshares": -12345678901234}
    ops = bodies(spark, (72, vote), (72, vote | {"rshares": "77", "weight": 10000}), (17, vote),
                 (61, {"author": "a", "permlink": "p"}), (72, {"author": "a", "voter": "v", "permlink": "p"}))
    columns = ["source_op", "is_vote", "author", "voter", "permlink", "rshares"]
    assert sorted_rows(normalize_ops(ops, 72), *columns) == [
        (1, True, "a", "v", "p", -12345678901234), (2, True, "a", "v", "p", 77), (3, False, "a", None, "p", None),
        (4, False, "a", None, "p", None), (5, True, "a", "v", "p", None)]
    assert [r.rshares for r in parse_votes(ops.where("source_op < 3")).collect()] == [-12345678901234, 77]
    assert {(r.voter, r.rshares) for r in parse_removals(ops.where("source_op in (3, 4)")).collect()} == {(None, None)}


@pytest.mark.parametrize("weight", ["twelve", 1.5, 2**63])
def test_bad_weight_is_an_error(spark, weight):
    ops = bodies(spark, (72, {"author": "a", "voter": "v", "permlink": "p", "rshares": weight}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        normalize_ops(ops, 72).collect()


def test_body_is_parsed_once(spark):
    parsed = normalize_ops(bodies(spark, (72, {"author": "a"})), 72)
    joined = resolve_ops(parsed, accounts_frame(spark, range(3)))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1, plan


@pytest.mark.parametrize("limits", [{}, {"strategy": "merge"}, {"strategy": "broadcast"}])
def test_resolution(spark, limits):
    ops = spark.createDataFrame([
        (1, True, "acct-1", "acct-2", "p", 5), (2, True, "acct-9", "acct-1", "p", 5),
        (3, True, "acct-1", "acct-9", "p", 5), (4, False, "acct-2", None, "p", None),
        (5, True, "acct-1", "acct-2", None, 5), *[(i, True, "acct-1", "acct-2", "q", i) for i in range(6, 30)],
    ], "source_op long, is_vote boolean, author string, voter string, permlink string, rshares long")
    found = resolve_ops(ops, accounts_frame(spark, range(4)), **limits)
    rows = sorted_rows(found, "source_op", "author_id", "voter_id", "permlink")
    assert rows[:3] == [(1, 1, 2, "p"), (3, 1, None, "p"), (4, 2, None, "p")]
    assert len(rows) == 3 + 24
    good, bad = quarantine(found)
    assert [r.source_op for r in bad.collect()] == [3] and good.count() == 26


def test_account_lookup(spark):
    accounts = accounts_frame(spark, range(3))
    names = spark.createDataFrame([("acct-1",), (None,)], "name string")
    found = resolve_accounts(names, accounts, required=False)
    assert {tuple(r) for r in found.collect()} == {("acct-1", 1), (None, None)}
    for frame, required in ((names, True), (spark.createDataFrame([("acct-7",)], "name string"), False)):
        with pytest.raises(Exception, match="does not exist"):
            resolve_accounts(frame, accounts, required).collect()


def test_dictionary_keeps_ids(spark):
    empty = spark.createDataFrame([], schemas.PERMLINKS)
    strings = [f"s-{i}" for i in range(500)]

    def frame(values):
        return spark.createDataFrame([(v,) for v in values], "permlink string")

    first = extend_dictionary(empty, frame(strings[:200] * 2 + [None]), buckets=16).checkpoint()
    second = extend_dictionary(first, frame(strings[100:]), buckets=16).checkpoint()
    old = {r.permlink: r.permlink_id for r in first.collect()}
    ids = {r.permlink: r.permlink_id for r in second.collect()}
    assert set(ids) == set(strings) and sorted(ids.values()) == list(range(1, 501))
    assert all(ids[s] == i for s, i in old.items())
    ops = frame(strings[:5] + ["s-0"] * 40).withColumn("source_op", F.monotonically_increasing_id())
    needed = batch_dictionary(second, ops)
    assert sorted(r.permlink for r in needed.collect()) == sorted(strings[:5])
    for table in (second, needed):
        assert sorted(r.permlink_id for r in encode(ops, table).collect()) == sorted(
            [ids[s] for s in strings[:5]] + [ids["s-0"]] * 40)


def test_dump_round_trip_and_diff(spark, tmp_path):
    accounts = accounts_frame(spark, range(10))
    current = spark.createDataFrame([(i, i * 10) for i in range(8)], "account_id int, reputation long")
    path = scratch_path(spark, "test-dump")
    expected = current.where("account_id > 0").selectExpr(
        "account_id", "if(account_id = 3, 1, reputation) as reputation").unionByName(
        spark.createDataFrame([(9, 5)], "account_id int, reputation long"))
    write_dump(expected, accounts, path, rows_per_document=2)
    loaded = load_dump(spark, path, accounts)
    assert sorted_rows(loaded, "account_id", "reputation") == sorted_rows(expected, "account_id", "reputation")
    assert [r.account_id for r in expected_diff(loaded, current).collect()] == [3]
    assert sorted(r.account_id for r in expected_diff(loaded, current, strict=True).collect()) == [0, 3, 9]
    detail = diff_detail(loaded, current, expected_diff(loaded, current))
    assert sorted_rows(detail, "side", "account_id", "reputation") == [("current", 3, 30), ("expected", 3, 1)]
    single = tmp_path / "dump.json"
    single.write_text(json.dumps({"result": {"reputations": [
        {"account": "acct-1", "reputation": 7}, {"account": "nobody", "reputation": 8}]}}, indent=1))
    assert {tuple(r) for r in load_dump(spark, str(single), accounts).collect()} == {(1, 7), (None, 8)}


def test_status(spark):
    start = datetime(2024, 1, 1)
    rows = [(v, str(v), {"0": [str(v)]}, {"0": [str(v)]}, "ranges", v, {"ranges": v}, v * 10 - 9, v * 10, v, 0, 1, 2, start + timedelta(seconds=v),
             start + timedelta(seconds=v, milliseconds=500), "x") for v in (1, 2, 3)]
    progress = spark.createDataFrame(rows, schemas.PROGRESS)
    assert tuple(sync_throughput(progress).first()) == (3, 1.5, 0.5)

    def healthy(head, seconds, began=start):
        return sync_status(progress, head, began, start + timedelta(seconds=seconds)).first().healthy

    assert healthy(31, 10)
    assert not healthy(31, 64)
    assert healthy(30, 64)
    assert not healthy(31, 10, began=start + timedelta(seconds=5))


#: Bodies that are no single JSON object, and what the strict ones hold: author and weight.
BROKEN = ['{"author":"a","rshares":5} trailing', '{"author":"a"}{"author":"b"}', '{"author":"a"},{"author":"b"}', "{'author':'a'}",
          '{"author":"a"}] x', '{"author":"a"},7] x', '{"author":"a",}', '{"author":"a","rshares":01}', '{"author":"a" /* c */}',
          "", " ", None, "[1]", "5", "null", '"text"', '{"author":"a"', '{"author":"a","rshares":NaN}']
STRICT = [('{"author":"a","rshares":5}', "a", 5), (' \n{"author":"a","rshares":"-12"}\t ', "a", -12), ('{"author":"a","rshares":1e3}', "a", 1000),
          ('{"author":"a","rshares":-9223372036854775808}', "a", -(2**63)), ('{"author":"a\\u00e9","rshares":null}', "aé", None),
          ('{"author":5}', "5", None), ('{}', None, None), ('{"author":"]}","rshares":7, "x":[{"author":"b"}]}', "]}", 7)]
BAD_WEIGHTS = ["1.5", '"1e3"', "true", "1e19", "123456789012345678e1", "99999999999999999999", '"many"', "[1]"]


def test_strict_bodies(spark):
    frame = ops_frame(spark, [(i + 1, 1, 72, body) for i, body in enumerate(BROKEN)])
    assert {r.source_op for r in broken_bodies(frame).collect()} == set(range(1, len(BROKEN) + 1))
    assert whole_bodies(frame).count() == 0
    for op in frame.where("source_op in (1, 2, 4)").collect():
        with pytest.raises(Exception, match="does not parse"):
            parse_votes(ops_frame(spark, [tuple(op)])).collect()
    strict = ops_frame(spark, [(i, 1, 72, body) for i, (body, _, _) in enumerate(STRICT)])
    assert broken_bodies(strict).count() == 0
    found = {r.source_op: (r.author, r.rshares) for r in parse_votes(strict).collect()}
    assert found == {i: (author, weight) for i, (_, author, weight) in enumerate(STRICT)}


@pytest.mark.parametrize("weight", BAD_WEIGHTS)
def test_weights_that_are_no_whole_number(spark, weight):
    frame = ops_frame(spark, [(1, 1, 72, '{"author":"a","voter":"b","permlink":"p","rshares":%s}' % weight)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        parse_votes(frame).collect()
    assert [r.rshares for r in normalize_ops(frame, 72, bad_weights=True).collect()] == [None]
