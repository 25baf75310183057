"""Operation logs derived from the general test tables, which hold no votes.

`dense_*` reads `events`: few accounts, many downvotes, removals and vote changes.
`wide_*` reads `orders`: one account per customer, few repeated votes.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore.session import cut_lineage
from votescore.sources.oplog import OpTypes

# Qualified names and ids of the operation types.
NAMES = OpTypes(
    vote="protocol::effective_comment_vote_operation",
    delete="protocol::delete_comment_operation",
    payout="protocol::comment_payout_update_operation",
)
TYPES = OpTypes(vote=72, delete=17, payout=61)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A test table is one file with one row group, which a single task would read and turn to JSON."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _account(number: Column) -> Column:
    return F.concat(F.lit("acct-"), number.cast("string"))


def _body(is_vote: Column, author: Column, voter: Column, permlink: Column, rshares: Column,
          as_text: Column) -> Column:
    """Vote bodies with the weight as a JSON number or string, removal bodies without voter and weight."""
    head = {"author": author, "permlink": permlink}
    fields = [value.alias(name) for name, value in head.items()]
    number = F.to_json(F.struct(*fields, voter.alias("voter"), rshares.alias("rshares")))
    text = F.to_json(F.struct(*fields, voter.alias("voter"), rshares.cast("string").alias("rshares")))
    removal = F.to_json(F.struct(*fields))
    return F.when(~is_vote, removal).when(as_text, text).otherwise(number)


def dense_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"))
    op = F.col("event_id") + 1
    is_vote = F.col("event_type") != "error"
    sign = F.when(F.col("event_type").isin("view", "signup"), -1).otherwise(1)
    rshares = F.round(F.col("value") * 100).cast("long") * 10_000_000 * sign
    author = F.get_json_object("props", "$.k").cast("int") % 40
    return events.select(
        op.alias("source_op"),
        (F.floor(F.col("event_id") / 10) + 1).cast("int").alias("block_num"),
        F.when(is_vote, TYPES.vote).when(op % 2 == 1, TYPES.delete).otherwise(TYPES.payout)
        .cast("short").alias("op_type_id"),
        _body(is_vote, _account(author), _account(F.col("user_id") % 40),
              F.concat(F.lit("post-"), (F.col("event_id") % 3).cast("string")), rshares, op % 2 == 0)
        .alias("body_value"),
    )


def dense_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _spread(table(spark, sf_dir, "events").select("user_id", "props"))
    voters = events.select((F.col("user_id") % 40).cast("int").alias("id"))
    authors = events.select((F.get_json_object("props", "$.k").cast("int") % 40).alias("id"))
    # Written once: a real account dimension is a table, not a query over all events.
    return cut_lineage(voters.union(authors).distinct().select("id", _account(F.col("id")).alias("name")))


def wide_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _spread(table(spark, sf_dir, "orders").drop("o_orderdate"))
    customers = table(spark, sf_dir, "customer").count()
    key = F.col("o_orderkey")
    low = F.col("o_orderpriority") == "5-LOW"
    kind = (
        F.when(low & (key % 10 == 0), TYPES.delete).when(low & (key % 10 == 1), TYPES.payout)
        .otherwise(TYPES.vote)
    )
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    rshares = F.round(F.col("o_totalprice") * 100).cast("long") * 10_000 * sign
    return orders.select(
        (key + 1).alias("source_op"),
        (F.floor(key / 10) + 1).cast("int").alias("block_num"),
        kind.cast("short").alias("op_type_id"),
        _body(kind == TYPES.vote, _account((key * 7919) % customers), _account(F.col("o_custkey")),
              F.concat(F.lit("post-"), (key % 2).cast("string")), rshares, key % 2 == 0).alias("body_value"),
    )


def wide_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), _account(F.col("c_custkey")).alias("name"))
