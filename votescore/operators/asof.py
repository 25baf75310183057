"""As-of lookup: the newest state of a key before a moment.

Probes and states stand in one order, which is cut into pieces. Inside a piece the last state before a probe is a window
by key; what earlier pieces hold arrives as one row per key and piece. So a key with a third of all rows is split over all
pieces, and the rows are shuffled once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votescore.functions.branch import count_at_or_below
from votescore.session import cut_lineage


def as_of(probes: DataFrame, states: DataFrame, probe_key: str, key: str, at: str, values: dict[str, str],
          pieces: int, borders: list[int] | None = None) -> DataFrame:
    """The probes with the values (named as given) of the newest state of their key strictly before them, NULL if there is
    none or the key is NULL. `at` orders both; a key has at most one state at a moment. `borders` are the last moments of all
    pieces but the last, ascending; without them `pieces` ranges are drawn, for which the rows are computed twice."""
    state = F.struct(*[F.col(c).alias(name) for c, name in values.items()])
    rows = probes.select(
        F.col(probe_key).alias("_key"), F.col(at).alias("_at"), F.struct(*probes.columns).alias("_probe"),
    ).unionByName(states.select(F.col(key).alias("_key"), F.col(at).alias("_at"), state.alias("_state")), allowMissingColumns=True)
    # Equal moments come into one piece. The pieces are checkpointed, because ranges must not be drawn twice.
    if borders is None:
        cut = cut_lineage(rows.repartitionByRange(pieces, "_at").withColumn("_piece", F.spark_partition_id()))
    else:
        piece = F.coalesce(count_at_or_below(F.col("_at") - 1, borders).cast("int"), F.lit(0)) if borders else F.lit(0)
        cut = cut_lineage(rows.withColumn("_piece", piece).repartitionById(len(borders) + 1, "_piece"))

    over_pieces = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("_state").isNotNull(), F.col("_at"))
    carried = cut.where(F.col("_key").isNotNull()).groupBy("_key", "_piece").agg(F.max_by("_state", held).alias("_state")).select(
        "_key", "_piece", F.last("_state", ignorenulls=True).over(over_pieces).alias("_before")).where("_before is not null")
    # A probe stands before a state of the same moment. NULL keys have nothing to look up and stay out of the window.
    inside = Window.partitionBy("_key", "_piece").orderBy("_at", F.col("_probe").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = cut.where(F.col("_key").isNotNull()).withColumn("_inside", F.last("_state", ignorenulls=True).over(inside)).where(
        "_probe is not null").join(carried, ["_key", "_piece"], "left").select("_probe", F.coalesce("_inside", "_before").alias("_found"))
    without = cut.where("_key is null and _probe is not null").select("_probe", F.col("_state").alias("_found"))
    names = list(values.values())
    return found.unionByName(without).select("_probe.*", *[F.col(f"_found.{n}").alias(n) for n in names])
