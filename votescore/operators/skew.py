"""Finding keys that are too big for one task, and cutting their rows into runs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.session import cut_lineage

# A key with more rows than this does not go through one window task. The limit is the same for any log.
HOT_ROWS = 1_000_000

_PLACES = (1 << 33) - 1


def hot_keys(df: DataFrame, cols: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows: a table, at most rows / hot_rows long."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*cols)


def split_hot(df: DataFrame, cols: Sequence[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, other rows). The planner broadcasts the keys by their size, or else splits the hot side."""
    return df.join(keys, list(cols), "left_semi"), df.join(keys, list(cols), "left_anti")


def in_runs(df: DataFrame, cols: Sequence[str], run_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with `piece`: ranges of `cols`, each at most half of `run_rows` long, numbered in ascending order, with gaps.

    The first columns name the key and the last ones order its rows, so every key is cut at its own quantiles: a key
    in as many pieces as its rows need, or several small keys in one. A task cuts as many pieces as its range needs,
    so short pieces need no more tasks than long ones. The pieces are checkpointed, because ranges must not be drawn twice.
    """
    total, length = df.count(), max(1, run_rows // 2)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-2 * total // HOT_ROWS))
    ranged = df.repartitionByRange(max(1, min(-(-total // length), tasks)), *cols).sortWithinPartitions(*cols)
    # The partition in the upper bits, the place in it in the lower 33.
    place = F.monotonically_increasing_id()
    piece = place - place.bitwiseAND(_PLACES) + F.floor(place.bitwiseAND(_PLACES) / length)
    return cut_lineage(ranged.withColumn("piece", piece))
