import re

from votescore import schemas
from votescore.operators.links import REMOVAL, VOTE, ROW

ROWS = "author_id int, voter_id int, permlink string, rshares bigint, source_op bigint, kind int"
VOTES = "author_id int, voter_id int, rshares bigint, prev_rshares bigint, source_op bigint"


def ops_frame(spark, ops):
    return spark.createDataFrame(ops, schemas.OPERATIONS)


def accounts_frame(spark, ids):
    return spark.createDataFrame([(i, f"acct-{i}") for i in ids], schemas.ACCOUNTS)


def link_rows(spark, rows, vote_type=72):
    data = [(a, v if k == vote_type else None, f"post-{p}", w if k == vote_type else None, op,
             VOTE if k == vote_type else REMOVAL) for op, k, a, v, p, w in rows]
    return spark.createDataFrame(data, ROWS).select(*ROW)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()),
                  key=lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r))


def reputation_rows(df):
    return sorted_rows(df, "account_id", "reputation", "is_implicit")


def active_rows(df):
    return sorted_rows(df, "author_id", "voter_id", "permlink", "rshares")


def size_digits(df):
    """Digits of the size that the planner expects, 0 if it has fewer than a dozen or so."""
    far = re.search(r"E\+(\d+)", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    return int(far[1]) if far else 0
