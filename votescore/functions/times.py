"""Durations."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)
