"""Raw reputation to the displayed integer score, exactly."""

from decimal import ROUND_CEILING, Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from votescore.functions.branch import count_at_or_below

# Fixed values of the score and the vote weight.
SCALING_BITS = 6
LOG_BASE = 10
LOG_OFFSET = 9
MULTIPLIER = 9
BASE_SCORE = 25

LONG_MAX = 2**63 - 1


def _thresholds() -> list[int]:
    """Smallest |reputation| that rounds to k + 1 points above the base, for every k that fits a LONG.

    round(9 * (log10(r) - 9)) passes from k to k + 1 at r = 10 ** (9 + (k + 1/2) / 9). That power is
    irrational, so no integer sits on the boundary and its ceiling is the first value above it.
    """
    steps = []
    with localcontext() as ctx:
        ctx.prec = 60
        k = 0
        while True:
            exponent = LOG_OFFSET + Decimal(2 * k + 1) / (2 * MULTIPLIER)
            step = int((Decimal(LOG_BASE) ** exponent).to_integral_value(ROUND_CEILING))
            if step > LONG_MAX:
                return steps
            steps.append(step)
            k += 1


THRESHOLDS = _thresholds()


def scaled(rshares: Column) -> Column:
    """Weight of a vote in reputation units: an arithmetic shift, so it floors below zero."""
    return F.shiftright(rshares, SCALING_BITS)


def score(reputation: Column) -> Column:
    """0 without reputation, else the base plus or minus the number of thresholds reached."""
    points = count_at_or_below(F.abs(reputation), THRESHOLDS)
    return (
        F.when(reputation.isNull() | (reputation == 0), F.lit(0))
        .when(reputation > 0, F.lit(BASE_SCORE) + points)
        .otherwise(F.lit(BASE_SCORE) - points)
        .cast("int")
    )
