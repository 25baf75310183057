"""Ranked lexical search turned round: documents stream through an inverted index of the queries.

The items (queries) are few, the documents many. An inverted index over the items' terms is broadcast, in blocks of at
most `block_postings` postings. A first pass counts words and the index's terms in every document and writes these counts, one narrow
row per document; the corpus figures (documents, terms, documents per term) are sums over these rows. A second pass streams
the rows through the index: a document's terms add their integer weights to the items that hold them, and each task keeps a
heap of at most `k` documents per item. The heaps are merged in two steps, so no task gets more of an item than the root of their number.

Scores are whole numbers, so they do not depend on the order of work; equal scores are ordered by doc_id, a NULL one first.
NULL and texts without terms match nothing and do not count as documents. Items without terms, or whose terms are in no
document, have no rows. Repeated documents each stand in the ranking, also under one doc_id; an item_id that several rows
share names one item with all their terms. Without documents or items the result is empty.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votescore.llm.common import sliced, written
from votescore.llm.words import byte_table

#: Documents per item.
TOP = 10
#: Pairs of term and item in one broadcast index.
BLOCK_POSTINGS = 2_000_000
TERM_BYTES = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True).tobytes()
#: Bytes of a text whose terms are objects at the same time.
_PIECE = 1 << 20
#: Scores held at the same time: documents by items.
_CELLS = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    plain = text.translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= _PIECE else plain.find(b" ", at + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Index:
    """Terms of a block of items: a number per term, and the items (by their place) that hold each."""

    def __init__(self, items: dict[int | None, set[bytes]]):
        self.items = list(items)
        self.number: dict[bytes, int] = {}
        postings: list[list[int]] = []
        for place, held in enumerate(items.values()):
            for term in sorted(held):
                n = self.number.setdefault(term, len(postings))
                if n == len(postings):
                    postings.append([])
                postings[n].append(place)
        self.sizes = np.array([len(p) for p in postings], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.places = np.array([place for p in postings for place in p], np.int64)


def index_blocks(items: DataFrame, block_postings: int = BLOCK_POSTINGS) -> Iterator[Index]:
    """Items pass the driver one after the other, by id; a block is closed before it grows beyond its size."""
    held: dict[int | None, set[bytes]] = {}
    size, last = 0, None
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    for row in rows.orderBy("item_id").toLocalIterator():
        if size >= block_postings and row.item_id != last:
            yield Index(held)
            held, size = {}, 0
        mine = held.setdefault(row.item_id, set())
        before = len(mine)
        for piece in terms(bytes(row.text)):
            mine.update(piece)
        size, last = size + len(mine) - before, row.item_id
    if size:
        yield Index(held)


_COUNTED = "doc_id long, n long, terms array<int>, times array<int>"


def term_counts(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, its number of terms with repeats, and the terms of the index in it with how often they occur; documents without
    a term have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(index.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in sliced(batches, "text"):
            ids, sizes, found, times = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n, counts = 0, Counter()
                for piece in terms(text or b""):
                    n += len(piece)
                    counts.update(map(number, piece))
                if n:
                    counts.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(n)
                    found.append(list(counts.keys()))
                    times.append(list(counts.values()))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _COUNTED)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _offsets(column: pa.ListArray) -> np.ndarray:
    return column.offsets.to_numpy().astype(np.int64)


def _heaps(counted: DataFrame, index: Index, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id and score: per task and item the k best documents."""
    sent = counted.sparkSession.sparkContext.broadcast((index.items, index.sizes, index.first, index.places, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sizes, first, places, weights = sent.value
        heaps: list[list[tuple[int, float | int]]] = [[] for _ in items]
        floor = np.zeros(len(items), np.int64)  # a score below it cannot enter the item's heap any more
        step = max(1, _CELLS // max(1, len(items)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                bounds = _offsets(batch["terms"])
                term = batch["terms"].values.to_numpy()[bounds[0]:bounds[-1]].astype(np.int64)
                times = batch["times"].values.to_numpy()[_offsets(batch["times"])[0]:_offsets(batch["times"])[-1]].astype(np.int64)
                length = np.array([100 - 90 + 90 * n * documents // total for n in batch["n"].to_pylist()], np.int64)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                gain = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * length[doc]))
                # Every term's gain goes to each of its postings.
                spread = sizes[term]
                entry = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(first[term], spread)
                scores = np.zeros(batch.num_rows * len(items), np.int64)
                np.add.at(scores, np.repeat(doc, spread) * len(items) + places[entry], np.repeat(gain, spread))
                scores = scores.reshape(batch.num_rows, len(items))
                ids = batch["doc_id"].to_pylist()
                for d, i in zip(*(x.tolist() for x in np.nonzero((scores > 0) & (scores >= floor)))):
                    entry_of = (int(scores[d, i]), math.inf if ids[d] is None else -ids[d])
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry_of)
                    else:
                        heapq.heappushpop(heap, entry_of)
                    if len(heap) == k:
                        floor[i] = heap[0][0]
        rows = [(items[i], None if d == math.inf else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return counted.mapInArrow(run, "item_id long, doc_id long, score long")


def _merge(heaps: DataFrame, k: int) -> DataFrame:
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    tasks = max(1, heaps.rdd.getNumPartitions())
    shares = max(1, math.isqrt(tasks))
    some = heaps.withColumn("share", F.spark_partition_id() % shares)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*best))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item, of those with a score above 0."""
    found = None
    for index in index_blocks(items, block_postings):
        counted = written(term_counts(docs, index), "term-counts")
        corpus = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
        if not corpus.documents:
            break
        weights = np.full(len(index.number), weight(corpus.documents, 0), np.int64)
        # At most one row per term of the index, whose size is bounded.
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("holding")).collect():
            weights[row.term] = weight(corpus.documents, row.holding)
        best = _merge(_heaps(counted, index, weights, corpus.documents, corpus.total, k), k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
