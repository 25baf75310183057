"""Schemas of the inputs, the state tables and the progress records."""

from pyspark.sql import types as T

OPERATIONS = T.StructType([
    T.StructField("source_op", T.LongType()),
    T.StructField("block_num", T.IntegerType()),
    T.StructField("op_type_id", T.ShortType()),
    T.StructField("body_value", T.StringType()),
])

ACCOUNTS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
])

ACTIVE_VOTES = T.StructType([
    T.StructField("author_id", T.IntegerType()),
    T.StructField("voter_id", T.IntegerType()),
    T.StructField("permlink", T.StringType()),
    T.StructField("rshares", T.LongType()),
])

REPUTATION = T.StructType([
    T.StructField("account_id", T.IntegerType()),
    T.StructField("reputation", T.LongType()),
    T.StructField("is_implicit", T.BooleanType()),
])

PERMLINKS = T.StructType([
    T.StructField("permlink_id", T.LongType()),
    T.StructField("permlink", T.StringType()),
])

# One row per commit. `snapshot` names what it wrote (after a rewind the snapshot of an older commit); `reputation_in`
# and `votes_in` say for every bucket of a state table which snapshots hold it: a whole one, and changes since. Both are NULL
# for commits that are history only. `source` and `batch_id` name the delivered batch, `batches` the highest batch of
# every source so far; the counts say what the batch did to the votes.
_PLACES = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
PROGRESS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("snapshot", T.StringType()),
    T.StructField("reputation_in", _PLACES),
    T.StructField("votes_in", _PLACES),
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("batches", T.MapType(T.StringType(), T.LongType())),
    T.StructField("first_block", T.IntegerType()),
    T.StructField("last_block", T.IntegerType()),
    T.StructField("last_op", T.LongType()),
    T.StructField("deleted_votes", T.LongType()),
    T.StructField("upserted_votes", T.LongType()),
    T.StructField("queued_votes", T.LongType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("pipeline_version", T.StringType()),
])

DUMP = T.StructType([
    T.StructField("result", T.StructType([
        T.StructField("reputations", T.ArrayType(T.StructType([
            T.StructField("account", T.StringType()),
            T.StructField("reputation", T.LongType()),
        ]))),
    ])),
])
