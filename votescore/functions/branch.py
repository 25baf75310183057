"""Binary search over sorted constants as one Column expression."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_at_or_below(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending `bounds` are <= value, with log2(n) comparisons per row."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(bounds[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds))
