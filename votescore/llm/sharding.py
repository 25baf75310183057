"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in the order of doc_id. A Feistel network permutes the numbers below the next power of
four; results of N or more walk on along their cycle until they fall below N, so the numbers 0 to N - 1 are permuted
among themselves. Shard and slot are remainder and quotient of the permuted number by the shard count: row counts
differ by one at most, slots have no gaps, and the place of any row can be computed from its number alone.

Numbering: rows (id, size, checksum; no texts) are sorted over ranges and checkpointed; a row's number is its place in
its range plus the row counts of the ranges before. Only one count per range reaches the driver.

NULL text has no bytes and the checksum of an empty text. NULL ids come first; rows that share an id are ordered by
checksum and size; rows equal in all three get neighbouring numbers, in any order. An empty table gives an empty
result. Copies are rows of their own: this law balances rows and does not keep groups together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.session import cut_lineage

SHARDS = 16
SEED = 42
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Places of row numbers in a permutation of 0 to n - 1."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            left, right = right, left ^ (_mix(right ^ key) & low)
        return left << np.uint64(half) | right

    out = network(numbers.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = network(out[far])
    return out.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    slot, shard = np.divmod(permuted(numbers, n, seed), shards)
    return shard, slot


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "text_crc32", "size", "tie"]  # the tie lets equal rows be spread over ranges
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # The upper bits are the number of the range, the lower 33 the place in it.
    numbered = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = dict(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    size = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
    first, n = np.concatenate(([0], np.cumsum(size, dtype=np.int64))), sum(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch["at"].to_numpy()
            number = first[at >> 33] + (at & ((1 << 33) - 1))
            shard, slot = place(number, n, shards, seed)
            yield pa.record_batch(
                [batch["doc_id"], batch["size"], batch["text_crc32"], pa.array(number), pa.array(shard.astype(np.int32)),
                 pa.array(slot)], names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    return numbered.mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
