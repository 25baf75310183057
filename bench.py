"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

One untimed pass over the smallest tables starts the JVM code paths and the Python workers; then every
query runs once, from the raw tables to a fully computed result. The read path is timed apart: the slowest of twenty
lookups of one account in a committed state, and one live batch of a block on top of it.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from votescore import fixtures
from votescore.fixtures import TYPES
from votescore.plans.ranges import process_batch
from votescore.plans.scores import committed_score
from votescore.plans.state import StateStore
from votescore.queries import QUERIES
from votescore.session import scratch_path

HEADLINE = [
    "op_range_scan", "parsed_ops", "account_resolution", "vote_transitions", "vote_transitions_wide",
    "active_votes_wide", "raw_standing", "raw_standing_wide", "scores", "scores_wide", "vote_gates",
    "raw_standing_incremental", "stream_standing", "rewound_standing", "raw_standing_sliced", "account_score",
    "live_standing",
]


def read_path(spark: SparkSession, tables: str) -> dict[str, float]:
    ops, accounts = fixtures.wide_ops(spark, tables).persist(), fixtures.wide_accounts(spark, tables).persist()
    accounts.count()
    top = ops.agg(F.max("block_num").alias("block")).first().block
    store = StateStore(spark, scratch_path(spark, "bench-state")).create()
    process_batch(store, ops, accounts, TYPES, "bench", 0, 1, top - 1)
    lookups = []
    for i in range(20):
        started = time.perf_counter()
        committed_score(store, spark.createDataFrame([(f"acct-{7 * i + 1}",)], "name string"), accounts).collect()
        lookups.append(time.perf_counter() - started)
    started = time.perf_counter()
    process_batch(store, ops, accounts, TYPES, "bench", 1, top, top)
    return {"committed_account_score_max": round(max(lookups), 3), "live_batch_of_one_block": round(time.perf_counter() - started, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("votescore-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="votescore-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            run(name, warm)
        read_path(spark, warm)
    seconds = {name: run(name, sf_dir) for name in HEADLINE} | read_path(spark, sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
