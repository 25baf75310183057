"""Live processing of a growing operation log."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from votescore import schemas
from votescore.plans.ranges import process_batch
from votescore.plans.state import StateStore
from votescore.sources.oplog import OpTypes


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The log as a stream. Its writer must append in block order: file groups of later blocks are
    written after those of earlier blocks. A batch that goes back in order is refused."""
    reader = spark.readStream.schema(schemas.OPERATIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start(ops: DataFrame, accounts: DataFrame, types: OpTypes, store: StateStore, checkpoint: str,
          interval: str | None = None, limit_block: int | None = None, bad: str | None = None) -> StreamingQuery:
    """Applies every micro-batch to the state with the batch functions.

    With an `interval` it follows the log, without one it takes what is there and stops. A batch that
    is delivered again after a failure was either committed, and is skipped, or left no trace. An operation that
    cannot be used stops the stream, or goes below the path `bad`.
    """
    kept = ops if limit_block is None else ops.where(F.col("block_num") <= limit_block)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for its edges and for the work
        try:
            process_batch(store, batch, accounts, types, checkpoint, batch_id, bad=bad)
        finally:
            batch.unpersist()

    writer = (
        kept.where(F.col("op_type_id").isin(types.all))
        .writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
