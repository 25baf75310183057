"""Benchmark decontamination by multi-pattern search with block shifts (Wu and Manber).

Words are runs of letters, digits and characters beyond ASCII, in lower case. The patterns are the windows of `WINDOW`
consecutive words of every benchmark item; an item with fewer words is one pattern. Texts and patterns are written as
words with one blank between and around them, so a pattern occurs at word bounds only.

Patterns are searched in classes of similar length, so that a short one does not shorten the jumps of the rest. In a class,
with `least` the length of its shortest pattern, a table says for the hash of every block of `block` bytes how far the search
may move when it sees that block: up to `least - block + 1` if the block is in no pattern. Where it may not move at all,
the hash of the last bytes selects a bucket of test strings, and only those whose own hash is equal are compared with the
text, byte by byte. The search runs in many lanes of one buffer of texts at once, each with its own position.

Items become blocks of at most `block_windows` patterns. One block, a few dozen megabytes with its tables, is sent to the
executors at a time; texts are read once per block and never move. With several blocks the spans of a document are brought
together by one shuffle of narrow rows.

NULL and texts without words are hit by nothing; items without words or without an item_id give no pattern. Items that are
equal, or share windows, are all named. Repeated rows each have their row. Empty tables: no documents give no rows, no
items hit nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import sliced
from votescore.llm.words import BLANK, Words, byte_table, words_of

#: Consecutive words of a pattern.
WINDOW = 10
#: Patterns searched for in one pass.
BLOCK_WINDOWS = 200_000
#: Places looked at together.
LANES = 8192
NOT_WORDS = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)
_TABLE_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number with bits all over


def windows(text: bytes | None) -> Iterator[bytes]:
    """Patterns of an item, each with a blank at both ends."""
    words = words_of([text], NOT_WORDS)
    n = len(words.starts)
    for i in range(max(1, n - WINDOW + 1) if n else 0):
        yield b" " + words.data[words.starts[i]:words.ends[min(i + WINDOW, n) - 1] + 1].tobytes()


def _last_bytes(data: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """The `count` (at most 8) bytes that end at each place, as numbers."""
    value = np.zeros(len(at), np.uint64)
    for k in range(count):
        value = (value << np.uint64(8)) | data[at - (count - 1 - k)].astype(np.uint64)
    return value


def _mixed(value: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    value = (value ^ np.uint64(seed) if isinstance(seed, int) else value ^ seed) * _MIX
    return value ^ (value >> np.uint64(29))


def _tail_hash(data: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Hash of the `count` bytes that end at each place."""
    value = np.zeros(len(at), np.uint64)
    for back in range(0, count, 8):
        value = _mixed(_last_bytes(data, at - back, min(8, count - back)), value)
    return value


@dataclass
class PatternClass:
    """Shift table and buckets of patterns between `least` and twice as many bytes."""

    patterns: list[bytes]
    least: int
    block: int
    shift: np.ndarray
    tail: int
    buckets: np.ndarray
    of_bucket: list[list[int]]

    @staticmethod
    def of(patterns: list[bytes]) -> "PatternClass":
        least = min(map(len, patterns))
        block, tail = min(8, least), min(32, least)
        # Only the last `least` bytes of a pattern take part, as in any search by shifts.
        data = np.frombuffer(b"".join(p[-least:] for p in patterns), np.uint8)
        ends = np.arange(1, len(patterns) + 1) * least - 1
        shift = np.full(1 << _TABLE_BITS, least - block + 1, np.int32)
        for left in range(least - block, -1, -1):  # bytes between the block and the end; nearer ones win
            shift[_slot(_last_bytes(data, ends - left, block))] = left
        hashes = _tail_hash(data, ends, tail)
        buckets, of = np.unique(hashes, return_inverse=True)
        members: list[list[int]] = [[] for _ in buckets]
        for i, b in enumerate(of.tolist()):
            members[b].append(i)
        return PatternClass(patterns, least, block, shift, tail, buckets, members)

    def occurrences(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the last byte, pattern) of every occurrence in the buffer."""
        first, last = self.least - 1, len(data)
        if first >= last:
            return
        lanes = min(LANES, max(1, (last - first) // self.least))
        bounds = np.linspace(first, last, lanes + 1).astype(np.int64)
        at, stop = bounds[:-1].copy(), bounds[1:]
        raw = data.tobytes()
        while len(at):
            move = self.shift[_slot(_last_bytes(data, at, self.block))]
            stays = at[move == 0]
            if len(stays):
                hashes = _tail_hash(data, stays, self.tail)
                bucket = np.searchsorted(self.buckets, hashes)
                bucket[bucket == len(self.buckets)] = 0
                hit = self.buckets[bucket] == hashes
                for end, b in zip(stays[hit].tolist(), bucket[hit].tolist()):
                    for i in self.of_bucket[b]:
                        pattern = self.patterns[i]
                        if end + 1 >= len(pattern) and raw.endswith(pattern, 0, end + 1):
                            yield end, i
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]


def _slot(block: np.ndarray) -> np.ndarray:
    return (_mixed(block) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Patterns:
    """Patterns with the items that have them, in classes by length."""

    def __init__(self, items_of: dict[bytes, list[int]]):
        by_size: dict[int, list[bytes]] = {}
        for pattern in items_of:
            by_size.setdefault(len(pattern).bit_length(), []).append(pattern)
        self.classes = [PatternClass.of(group) for group in by_size.values()]
        self.items_of = items_of

    def search(self, words: Words) -> list[tuple[list[tuple[int, int]], list[int]]]:
        """Per text the spans of its hit words (from, to before; apart from each other) and the items found."""
        n = len(words.first) - 1
        hit = np.zeros(len(words.starts) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(n)]
        # One blank before every text, so that its first word has one too and no pattern lies in two texts.
        gaps = words.starts[words.first[:-1][np.diff(words.first) > 0]]
        data = np.insert(words.data, gaps, BLANK)
        starts = words.starts + np.searchsorted(gaps, words.starts, side="right")
        for group in self.classes:
            for end, i in group.occurrences(data):
                pattern = group.patterns[i]
                begin = end - len(pattern) + 2  # its first word
                low, high = np.searchsorted(starts, [begin, end]).tolist()
                hit[low] += 1
                hit[high] -= 1
                found[int(np.searchsorted(words.first, low, side="right")) - 1].update(self.items_of[pattern])
        covered = (np.cumsum(hit[:-1]) > 0).astype(np.int8)
        out = []
        for t in range(n):
            low, high = int(words.first[t]), int(words.first[t + 1])
            if not found[t]:
                out.append(([], []))
                continue
            edge = np.flatnonzero(np.diff(covered[low:high], prepend=0, append=0))
            out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist())), sorted(found[t])))
        return out


def pattern_blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[dict[bytes, list[int]]]:
    """Items by pattern, in blocks of at most so many pairs. Items pass the driver one after the other."""
    block: dict[bytes, list[int]] = {}
    held = 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where(
        "item_id is not null and text is not null")
    for item in items.toLocalIterator():
        for pattern in set(windows(bytes(item.text))):
            block.setdefault(pattern, []).append(item.item_id)
            held += 1
            if held >= block_windows:
                yield block
                block, held = {}, 0
    if block:
        yield block


_SCANNED = "doc_id long, key string, n_words long, spans array<struct<first:bigint,last:bigint>>, items array<bigint>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _scan(docs: DataFrame, block: dict[bytes, list[int]], key: Column) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(sent.value)
        for batch in sliced(batches, "text"):
            words = words_of(batch["text"].to_pylist(), NOT_WORDS)
            found = patterns.search(words)
            yield pa.record_batch(
                [batch["doc_id"], batch["key"], pa.array(np.diff(words.first)),
                 pa.array([[dict(first=a, last=b) for a, b in spans] for spans, _ in found], pa.list_(_SPAN)),
                 pa.array([items for _, items in found], pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_words", "spans", "items"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"),
        F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCANNED)


def _merged(spans: Column) -> Column:
    """Spans that ascend by their first word, with those that touch made one."""
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, lambda done, span: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= span["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["last"], span["last"]).alias("last")))),
    ).otherwise(F.concat(done, F.array(span))))


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (word numbers from, to before, of the stretches that stand in the benchmark) and items (ids,
    ascending) of every row."""
    blocks = pattern_blocks(benchmark, block_windows)
    block, following = next(blocks, {}), next(blocks, None)
    if following is None:
        return _scan(docs, block, F.lit("")).select("doc_id", "n_words", "spans", "items")
    together = None
    for i, block in enumerate(chain([block, following], blocks)):
        scan = _scan(docs, block, F.md5(F.col("text").cast("binary"))).withColumn("block", F.lit(i))
        together = scan if together is None else together.unionByName(scan)
    # Rows with one key are one document several times: each block saw it as often, and so often it is returned.
    return together.groupBy("doc_id", "key", "n_words").agg(
        _merged(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.when(F.col("block") == 0, 1)).alias("copies"),
    ).select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row doc_id, n_words, n_hit (words in an occurrence), n_items, a digest of the items, and whether any word is hit."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))
