from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest

from tests.helpers import accounts_frame
from votescore.functions import score as S
from votescore.plans.scores import account_score, scores


def by_formula(value):
    """The score from a logarithm with 60 digits."""
    if not value:
        return 0
    with localcontext() as ctx:
        ctx.prec = 60
        points = max(Decimal(abs(value)).log10() - 9, Decimal(0)) * 9
        return int((25 + (points if value > 0 else -points)).to_integral_value(ROUND_HALF_UP))


def test_thresholds():
    assert (len(S.THRESHOLDS), S.THRESHOLDS[0], S.THRESHOLDS[-1]) == (90, 1136463667, 8799225435691070302)


def test_every_threshold_from_both_sides(spark):
    values = [0, None, 1, -1, 10**9, -(10**9), 2**63 - 1, -(2**63) + 1]
    values += [sign * (t + d) for t in S.THRESHOLDS for d in (-1, 0, 1) for sign in (1, -1)]
    frame = spark.createDataFrame([(v,) for v in values], "r long")
    for row in frame.withColumn("s", S.score(frame.r)).collect():
        assert row.s == by_formula(row.r), row


def test_smallest_long_is_an_error(spark):
    frame = spark.createDataFrame([(-(2**63),)], "r long")
    with pytest.raises(Exception, match="OVERFLOW"):
        frame.select(S.score(frame.r)).collect()


def test_scores_of_accounts(spark):
    state = spark.createDataFrame([(1, 10**12, False), (2, -(10**12), False), (3, 0, True)],
                                  "account_id int, reputation long, is_implicit boolean")
    accounts = accounts_frame(spark, range(5))
    assert {r.account_id: r.score for r in scores(state, accounts).collect()} == {0: 0, 1: 52, 2: -2, 3: 0, 4: 0}
    names = spark.createDataFrame([("acct-1",), ("acct-4",), ("acct-1",)], "name string")
    assert {tuple(r) for r in account_score(names, state, accounts).collect()} == {("acct-1", 52), ("acct-4", 0)}
    unknown = spark.createDataFrame([("somebody",)], "name string")
    with pytest.raises(Exception, match="Account 'somebody' does not exist"):
        account_score(unknown, state, accounts).collect()
