"""The operation log, the account dimension and the operation-type dimension."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore import schemas


@dataclass(frozen=True)
class OpTypes:
    """One value for each of the three operation types that matter: their ids, or their qualified names."""

    vote: int | str
    delete: int | str
    payout: int | str

    @property
    def all(self) -> list:
        return [self.vote, self.delete, self.payout]


def op_type_ids(op_types: DataFrame, names: OpTypes) -> OpTypes:
    """Ids of the types with the given qualified names, read once so that they enter later plans as literals.
    Every name must stand in the table exactly once."""
    found = op_types.where(F.col("name").isin(names.all)).groupBy("name").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).collect()
    ids = {r.name: r.id for r in found}
    wrong = sorted(set(names.all) - ids.keys()) + sorted(r.name for r in found if r.n > 1)
    if wrong:
        raise ValueError(f"operation types missing or not unique: {wrong}")
    return OpTypes(*(ids[name] for name in names.all))


def op_type_id_array(op_types: DataFrame, names: OpTypes) -> DataFrame:
    """One row: the sorted id list, its length and its text form."""
    ids = F.array_sort(F.collect_set("id"))
    return (
        op_types.where(F.col("name").isin(names.all)).agg(ids.alias("ids"))
        .select("ids", F.size("ids").alias("n_ids"),
                F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids_text"))
    )


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPERATIONS).parquet(path)


def scan_ops(ops: DataFrame, types: OpTypes, first_block: int | None = None,
             last_block: int | None = None) -> DataFrame:
    """Relevant operations of a block range.

    On a log written by `write_ops` the type test prunes directories and the block test prunes
    row groups; only the columns used later are read.
    """
    kept = ops.where(F.col("op_type_id").isin(types.all))
    if first_block is not None:
        kept = kept.where(F.col("block_num") >= first_block)
    if last_block is not None:
        kept = kept.where(F.col("block_num") <= last_block)
    return kept


def write_ops(ops: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Log laid out by operation type, every file a contiguous run of operations.

    The range partitioning makes the block statistics of files and row groups narrow, so a range
    scan touches few of them.
    """
    keys = ["op_type_id", "source_op"]
    laid = ops.repartitionByRange(files, *keys) if files else ops.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).write.mode(mode).partitionBy("op_type_id").parquet(path)


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ACCOUNTS).parquet(path).select("id", "name")
