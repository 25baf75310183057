"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where over half of the text's 3-word shingles have it set in their XXH64. Fingerprints
within `RADIUS` bits are linked; a document's component is the smallest doc_id reachable over links.

Search: equal fingerprints are one row from the start. The 64 bits are split into five parts; two fingerprints that
differ in at most three bits agree in at least two parts, so each goes into ten tables keyed by two parts (about 26
bits). A bucket with more than `BUCKET` fingerprints is split again the same way on the bits not yet in its key; after
the third split only about 14 bits are free, so a bucket is bounded for any input and no cap is needed.

Comparison: the fingerprints of buckets lie in blocks of 64 lanes, stored as 64 bit planes of one word each. A
fingerprint meets a whole block at once: plane by plane the differing lanes are added to carry-save counters (ones,
twos, over), and a block is abandoned as soon as all its lanes are over the radius. Of the links found in a task only
a spanning forest leaves it. Components come from alternating star steps over these edges.

The pipeline's stage wants more: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more
(`similar_classes`). The same search runs first, over a fingerprint of each set: tables, planes and components, with an
exact check of every pair found (`search`). A similarity of 0.8 means some ten bits of 64, too many for tables, so a second
search brings what the first can't reach. Similar sets share a shingle among the rarest fifth of each (`prefix`), so documents
meet by these, for certain. Of those that meet, the ones that the first search connected need no more; fingerprints of 256
bits set aside the ones that are far from similar: 0.8 means 15 % of the bits, 38, and `WIDE_RADIUS` is seven standard
deviations above. The rest are verified on their sets, and only similar ones are linked. A bucket (shingle) with over BUCKET rows is cut into blocks and compared block by block in separate
tasks, so its pairs meet as surely as others, at a cost that grows with its square; frequent shingles come last in the
order and seldom are in a prefix. Components are the same.

With `fingerprints` the groups hold all links of the operator too: fingerprints over three words, repeats included, within
`RADIUS` bits, whatever the similarity of the sets. These come first, and pairs that they connect need no set.

NULL or blank texts have fingerprint zero, like any other zero. Repeated rows and rows that share a doc_id get the
component of their fingerprint; a NULL doc_id counts only if no other is in the component (then component_id is NULL).
An empty table gives an empty result.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import document_key, packed, sliced, unpacked, with_row, written
from votescore.session import cut_lineage

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Largest bucket that is compared as it is.
BUCKET = 4096
#: Shingles of a text whose places are Python numbers at the same time.
SPANS = 65_536
#: Rows of whole buckets that are compared together.
TOGETHER = 65_536
#: The stage's search: words of 64 bits, words in a shingle, differing bits.
WIDE = 4
WIDE_SHINGLE = 5
WIDE_RADIUS = 80
#: Bits of a shingle's bin, and one of how many documents is counted.
BIN_BITS = 18
SAMPLED = 16
#: Close pairs a row from which a bucket is dense, and shingles in a tile of dense rows.
DENSE = 8
TILE = 4 << 20
PAIR, LARGE, DENSE_ROW = range(3)
WORDS = [f"f{k}" for k in range(WIDE)]
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ----------------------------------------------------------------------------------


def _spaced(text: bytes) -> bytes:
    """The words of a text, A-Z in lower case, with one blank behind each but perhaps the last."""
    raw = np.frombuffer(text.lower(), np.uint8)
    parts, before = [], np.zeros(1, bool)
    for at in range(0, len(raw), 1 << 20):
        part = raw[at:at + (1 << 20)]
        inside = (part != 32) & ((part < 9) | (part > 13))
        kept = inside | np.concatenate((before, inside[:-1]))
        parts.append(np.where(inside, part, np.uint8(32))[kept].tobytes())
        before = inside[-1:]
    return b"".join(parts)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every shingle."""
    import xxhash

    joined = _spaced(text or b"")
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if not joined.endswith(b" ") and joined:
        ends = np.append(ends, len(joined))
    if not len(ends):
        return np.empty(0, "<u8")
    last = ends[min(size, len(ends)) - 1:]
    digest = xxhash.xxh64_intdigest

    def first(at: int) -> np.ndarray:
        return ends[at - 1:at + SPANS - 1] + 1 if at else np.concatenate(([0], ends[:SPANS - 1] + 1))

    return np.fromiter((digest(joined[a:b], SEED) for at in range(0, len(last), SPANS)
                        for a, b in zip(first(at).tolist(), last[at:at + SPANS].tolist())), "<u8", len(last))


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit into a byte
        bits = np.unpackbits(hashes[at:at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint over all shingles, repeats included."""
    hashes = shingle_hashes(text, size)
    return majority(hashes) if len(hashes) else 0


def wide_print(hashes: np.ndarray) -> list[int]:
    """Four words over a set of shingle hashes; each word has hashes of its own, mixed from XXH64."""
    if not len(hashes):
        return [0] * WIDE
    words = []
    for k in range(WIDE):
        h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(majority(np.ascontiguousarray(h ^ (h >> np.uint64(31)))))
    return words


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, key and fingerprint (signed 64 bits) of every row, without the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            prints = np.fromiter(map(fingerprint, batch["text"].to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array(prints.view(np.int64))],
                                  names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), document_key(docs["doc_id"], docs["text"]).alias("key"),
                       F.col("text").cast("binary")).mapInArrow(read, "doc_id long, key long, fp long")


# --- tables ----------------------------------------------------------------------------------------


def _split(mask: int) -> list[int]:
    """The ten unions of mask with two of five equal parts of the bits outside it."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[len(free) * i // 5:len(free) * (i + 1) // 5]) for i in range(5)]
    return [mask | parts[i] | parts[j] for i in range(5) for j in range(i)]


def masks(level: int) -> list[int]:
    """Key bits of the tables of a level; the tables below table t are 10 t to 10 t + 9."""
    return [0] if level == 0 else [m for parent in masks(level - 1) for m in _split(parent)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(level: int, parent: Column | None = None) -> Column:
    """Array of (table, mask): all tables of the first level, or those below a parent."""
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).cast("long").alias("m"))
                      for t, m in enumerate(masks(level))])
    return pairs if parent is None else F.slice(pairs, parent * 10 + 1, F.lit(10))


def _buckets(rows: DataFrame, tables: Column) -> DataFrame:
    return rows.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("part"))


# --- comparison ------------------------------------------------------------------------------------


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes (block, bit) of fingerprints (row, word) in blocks of 64 lanes."""
    width = prints.shape[1] * 8
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 64, width), axis=2, bitorder="little")
    words = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view("<u8")[:, :, 0]


def close_pairs(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (u < v) within the radius; every such pair of the same bucket is among them.

    Rows of a bucket are neighbours. A block meets itself and the blocks in which its last bucket goes on. The
    counters are planes of one binary digit each, starting so that one more than the radius overflows them.
    """
    prints = np.ascontiguousarray(prints.reshape(len(prints), -1))
    n, width = prints.shape
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    blocks = -(-n // 64)
    padded = np.zeros((blocks * 64, width), np.uint64)
    padded[:n] = prints
    planes = _planes(padded)
    last_row = np.minimum(np.arange(1, blocks + 1) * 64, n) - 1
    bucket_end = np.searchsorted(bucket, bucket[last_row], "right") - 1
    reach = bucket_end // 64 - np.arange(blocks) + 1
    left = np.repeat(np.arange(blocks), reach)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)
    for at in range(0, len(left), 256):
        row = (left[at:at + 256, None] * 64 + np.arange(64)).ravel()
        block = np.repeat(right[at:at + 256], 64)
        row, block = row[row < n], block[row < n]
        over = np.zeros(len(row), np.uint64)
        counters = [np.full(len(row), _ALL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
        for bit in range(64 * width):
            own = prints[row, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
            carry = planes[block, bit] ^ (np.uint64(0) - own)  # the lanes that differ
            for d in range(digits):
                counter = counters[d]
                counters[d], carry = counter ^ carry, counter & carry
            over |= carry
            if bit % 8 == 7:
                alive = over != _ALL
                if not alive.all():
                    row, block, over = row[alive], block[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(row):
                        break
        lanes = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(lanes)
        u, v = row[hit], block[hit] * 64 + lane
        real = (u < v) & (v < n)
        if real.any():
            yield u[real], v[real]


def smallest_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        if (low == label[u]).all() and (low == label[v]).all():
            return label
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]


def _forest(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows at both ends of the edges of a spanning forest over the close pairs."""
    label = np.arange(len(prints))
    for u, v in close_pairs(prints, bucket, radius):
        step = smallest_reachable(len(prints), label[u], label[v])
        label = step[label]
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return label[moved], moved


def _compare(batches: Iterator[pa.RecordBatch], words: list[str], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, part, node, fingerprint words) sorted by bucket: compared TOGETHER at a time, never cutting a bucket."""

    def edges(t: np.ndarray, part: np.ndarray, node: np.ndarray, *prints: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (part[1:] != part[:-1])))
        a, b = _forest(np.stack(prints, 1).view(np.uint64), np.cumsum(new), radius)
        differ = node[a] != node[b]
        return pa.record_batch([pa.array(node[a][differ]), pa.array(node[b][differ])], names=["a", "b"])

    columns = ["t", "part", "node", *words]
    held = [np.empty(0, np.int64)] * len(columns)
    for batch in batches:
        held = [np.concatenate((h, batch[c].to_numpy().astype(np.int64))) for h, c in zip(held, columns)]
        t, part = held[:2]
        if len(t) < TOGETHER:
            continue
        whole = np.flatnonzero((t != t[-1]) | (part != part[-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield edges(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield edges(*held)


def _compared(buckets: DataFrame, words: list[str], radius: int) -> DataFrame:
    dealt = buckets.select("t", "part", "node", *words).repartition("t", "part")
    return dealt.sortWithinPartitions("t", "part", *words).mapInArrow(
        partial(_compare, words=words, radius=radius), "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` with the connectivity of all links."""
    rows, found, level = _buckets(prints, _tables(1)), None, 1
    while True:
        sizes = rows.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = rows.join(sizes, ["t", "part"])
        last = level == 3
        cold = sized if last else sized.where(F.col("n") <= BUCKET)
        edges = _compared(cold.withColumn("node", F.col("fp")), ["fp"], RADIUS)
        found = edges if found is None else found.union(edges)
        if last:
            break
        hot = sized.where(F.col("n") > BUCKET).select("t", "fp")
        hot = cut_lineage(hot)
        if hot.isEmpty():
            break
        level += 1
        rows = _buckets(hot, _tables(level, F.col("t")))
    return found.distinct()


# --- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from every node of the edges (a, b).

    Alternating star steps: every node hands its neighbours to the smallest of them, first the larger neighbours,
    then the smaller ones, until nothing changes. Steps work on sums per node and joins, so a node with many
    neighbours is no group of one task.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        near = smallest(both).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(near, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b always
        near = smallest(down)
        moved = down.join(near, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        return moved.union(near.select(F.col("m").alias("a"), F.col("u").alias("b")))

    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")).first()
        if state == seen:
            break
        seen = state
        edges = cut_lineage(small_star(large_star(edges).distinct()).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp and component_id of every row."""
    prints = cut_lineage(with_fingerprint(docs))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_class, "fp")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- similar documents -----------------------------------------------------------------------------


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets of a sample of the documents (key, text) have a shingle of each bin. Any counts give right results;
    they only put frequent shingles last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BIN_BITS, np.int64)
        for batch in sliced(batches, "text"):
            for text in batch["text"].to_pylist():
                total += np.bincount(_bin(np.unique(shingle_hashes(text, size))), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bin", "n"])

    sample = texts.where(F.pmod("key", F.lit(SAMPLED)) == 0).select("text")
    counts = np.zeros(1 << BIN_BITS, np.int64)
    found = sample.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bin"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest fifth of a set, and one more: similar sets have at least four fifths of the larger one in common, so
    the first of the common ones, in an order that is the same for all, is in both prefixes."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts[_bin(hashes)]))[:n - (4 * n + 4) // 5 + 1]]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different rows (part, node), sorted, of parts with several nodes. Holds one row between batches."""
    part, node, before = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        part = np.concatenate((part, batch["part"].to_numpy()))
        node = np.concatenate((node, batch["node"].to_numpy()))
        if not len(part):
            continue
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (node[1:] != node[:-1])))
        part, node = part[new], node[new]
        same = part[1:] == part[:-1]
        met = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        yield pa.record_batch([pa.array(part[:-1][met[:-1]]), pa.array(node[:-1][met[:-1]])], names=["part", "node"])
        before, part, node = bool(met[-1]), part[-1:], node[-1:]
    if before:
        yield pa.record_batch([pa.array(part), pa.array(node)], names=["part", "node"])


def _tiles(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows (t, part, node, ...) once for each tile they are in; `part` becomes the tile's.

    A bucket is dealt by hash into blocks of about half of `most` by weight, and each two of its blocks are a tile. So
    any two rows of a bucket share a tile, and no task holds a bucket.
    """
    blocks = rows.groupBy("t", "part").agg(F.ceil(2 * F.sum(weight) / most).cast("int").alias("blocks"))
    spread = rows.repartition("node").join(F.broadcast(blocks.where("blocks > 1")), ["t", "part"], "left")
    block = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    dealt = spread.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    tile = F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.where("block <> other or blocks is null").withColumn("part", tile).drop("blocks", "block", "other")


def _pairs_or_pass(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, part, node, words) sorted by bucket; `kind` says what a row of the result is.

    PAIR: nodes (a, b) within the radius, all such pairs of a bucket. LARGE: rows of a bucket over `most` rows, as they
    are; they are never held. DENSE: rows that have partners in a bucket with over DENSE pairs a row.
    """
    columns = ["t", "part", "node", *WORDS]

    def passed(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(rows.shape[1], pa.int64())
        kinds = pa.array(np.full(rows.shape[1], kind, np.int32))
        return pa.record_batch([kinds, none, none, *(pa.array(r) for r in rows)], names=["kind", "a", "b", *columns])

    def whole_buckets(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))))
        size = np.diff(start, append=rows.shape[1])
        own = np.repeat(size, size)
        if (own > most).any():
            yield passed(LARGE, rows[:, own > most])
        small = (own > 1) & (own <= most)
        rows, size = rows[:, small], size[(size > 1) & (size <= most)]
        if not rows.shape[1]:
            return
        bucket, count = np.repeat(np.arange(len(size)), size), np.zeros(len(size), np.int64)
        met, found = np.zeros(rows.shape[1], bool), []
        for u, v in close_pairs(np.ascontiguousarray(rows[3:].T).view(np.uint64), bucket, WIDE_RADIUS):
            same = bucket[u] == bucket[v]
            u, v = u[same], v[same]
            met[u] = met[v] = True
            count += np.bincount(bucket[u], minlength=len(size))
            sparse = (count <= DENSE * size)[bucket[u]]
            found.append((u[sparse], v[sparse]))
        dense = (count > DENSE * size)[bucket]
        if (dense & met).any():
            yield passed(DENSE_ROW, rows[:, dense & met])
        for u, v in found:
            a, b = rows[2, u[~dense[u]]], rows[2, v[~dense[u]]]
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(np.full(len(a), PAIR, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)),
                                   *[none] * len(columns)], names=["kind", "a", "b", *columns])

    held, passing = np.empty((len(columns), 0), np.int64), None
    for batch in batches:
        held = np.concatenate((held, np.stack([batch[c].to_numpy().astype(np.int64) for c in columns])), axis=1)
        if passing is not None:
            go_on = (held[0] == passing[0]) & (held[1] == passing[1])
            if go_on.any():
                yield passed(LARGE, held[:, go_on])
            held = held[:, ~go_on]
        if not held.shape[1]:
            continue
        passing = None
        last = int(np.argmax((held[0] == held[0, -1]) & (held[1] == held[1, -1])))
        if held.shape[1] - last > most:
            passing = held[:2, -1].copy()
            yield passed(LARGE, held[:, last:])
            held = held[:, :last]
        if last and (passing is not None or held.shape[1] >= TOGETHER):
            yield from whole_buckets(held[:, :last])
            held = held[:, last:]
    if held.shape[1]:
        yield from whole_buckets(held)


def candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes with close fingerprints and a common shingle in their prefixes, and rows (t, part, node,
    words) of dense buckets, whose pairs are not listed; prints have node, WORDS and prefix. A bucket is the nodes with
    one shingle; those over BUCKET rows are compared completely, in tiles."""

    def compared(rows: DataFrame, most: int) -> DataFrame:
        bucketed = "kind int, a long, b long, t long, part long, node long, " + ", ".join(f"{c} long" for c in WORDS)
        return cut_lineage(rows.select("t", "part", "node", *WORDS).repartition("t", "part")
                           .sortWithinPartitions("t", "part", *WORDS)
                           .mapInArrow(partial(_pairs_or_pass, most=most), bucketed))

    shared = prints.select(F.explode("prefix").alias("part"), "node").repartition("part").sortWithinPartitions(
        "part", "node").mapInArrow(_shared, "part long, node long")
    classes = prints.select("node", *WORDS).distinct()
    out = compared(shared.join(classes, "node").withColumn("t", F.lit(0).cast("long")), BUCKET)
    large = out.where(F.col("kind") == LARGE)
    if not large.isEmpty():
        out = out.union(compared(_tiles(large.drop("kind", "a", "b"), F.lit(1), BUCKET), 1 << 62))
    pairs = cut_lineage(out.where(F.col("kind") == PAIR).select("a", "b").distinct())
    return pairs, out.where(F.col("kind") == DENSE_ROW).drop("kind", "a", "b")


# --- their similarity ------------------------------------------------------------------------------


def _similar(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with `shared` common elements, `sizes` together, have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * sizes


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets (left, right) are similar."""
    for batch in batches:
        left, right = batch["left"], batch["right"]
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(side[i].as_buffer(), "<u8") for side in (left, right))
            good[i] = _similar(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good))


def similar_forest(prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect what all such pairs within the radius connect."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark, label, edges = np.zeros(len(ids), bool), np.arange(len(sets)), []
    for u, v in close_pairs(prints, np.zeros(len(sets), np.int64), WIDE_RADIUS):
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        for others in np.split(v, np.flatnonzero(np.diff(u)) + 1):
            x, u = u[0], u[len(others):]
            others = others[(label[others] != label[x]) & (sizes[others] > 0)]
            own = ids[ends[x] - sizes[x]:ends[x]]
            mark[own] = True
            for some in np.split(others, range(256, len(others), 256)):
                if len(some):
                    first = np.cumsum(sizes[some]) - sizes[some]
                    at = np.arange(sizes[some].sum()) + np.repeat(ends[some] - sizes[some] - first, sizes[some])
                    shared = np.add.reduceat(mark[ids[at]], first, dtype=np.int64)
                    for y in some[_similar(shared, sizes[some] + sizes[x])].tolist():
                        if label[y] != label[x]:
                            edges.append((int(x), y))
                            label[label == label[y]] = label[x]
            mark[own] = False
    return edges


def _similar_in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of rows (t, part, node, words, shingles) sorted by tile, one tile at a time."""

    def edges(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        prints = np.stack([rows[c].to_numpy() for c in WORDS], 1).view(np.uint64)
        found = similar_forest(prints, [np.frombuffer(x, "<u8") for x in rows["shingles"].to_pylist()])
        return pa.record_batch([pa.array(node[[f[k] for f in found]] if found else [], pa.int64()) for k in (0, 1)],
                               names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        t, part = held["t"].to_numpy(), held["part"].to_numpy()
        starts = np.flatnonzero((np.diff(t) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *starts], starts):
            yield edges(held.slice(a, b - a))
        if len(starts):
            held = held.slice(starts[-1])
    if held is not None:
        yield edges(held)


def search(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints, the first of WORDS, are within RADIUS bits. Nodes with one
    fingerprint are paired with the smallest of them, which stands for all in the tables."""
    classes = prints.select("node", F.col(WORDS[0]).alias("fp")).distinct()
    least = cut_lineage(classes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = classes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda fp, node: least.select(F.col("fp").alias(fp), F.col("least").alias(node))
    close = links(least.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b")
    return equal.union(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows (t, part, node, words, n) of dense buckets in fewer buckets, in which any two that shared one still do.

    Similar sets share many shingles, and as many buckets with nearly the same rows. Buckets that are connected by their rows
    become one, with each row once, unless it would be larger than a bucket or a tile may be.
    """
    rows = cut_lineage(rows)
    least = rows.groupBy("t", "part").agg(F.min("node").alias("a"))
    roots = components(rows.join(least, ["t", "part"]).where("node <> a").select("a", F.col("node").alias("b")))
    of_row = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("t", "part")
    once = cut_lineage(of_row.distinct())
    small = cut_lineage(once.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") + 1).alias("weight")).where(
        (F.col("rows") <= BUCKET) & (F.col("weight") <= TILE // 2)).select("root"))
    gathered = once.join(small, "root").select(F.lit(1).cast("long").alias("t"), F.col("root").alias("part"), "node", *WORDS, "n")
    others = once.join(small, "root", "left_anti").select("node")
    return gathered.unionByName(rows.join(others, "node", "left_semi"))


def _fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all nodes whose texts have fingerprints `fp` in one component."""
    classes = cut_lineage(prints.select("node", "fp").distinct())
    roots = components(links(classes.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("a"))
    return rooted.join(least, "root").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes have different roots."""
    root = lambda node: roots.select(F.col("node").alias(node), F.col("root").alias(f"root_{node}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_links(prints: DataFrame, texts: DataFrame, size: int, linked: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose sets of shingles are similar, and those that are `linked`; prints have key, node, WORDS
    and prefix, texts key and text.

    Sets are made again, of the candidates only. Pairs meet their sets in joins, first those that SimHash finds, then those
    between its components; rows of dense buckets take theirs along into tiles of about TILE shingles, so that sets move once
    per row and tile and not once per pair.
    """
    near = cut_lineage(search(prints))
    pairs, dense = candidates(prints)
    if linked is not None:
        linked = cut_lineage(linked)
        known = components(linked)
        near, pairs = (cut_lineage(_apart(some, known)) for some in (near, pairs))
    nodes = near.union(pairs).select(F.explode(F.array("a", "b")).alias("node")).union(dense.select("node")).distinct()
    wanted = prints.groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            # One text at a time: a slice is short in zstd frames only.
            sets = [np.unique(shingle_hashes(*unpacked([t]), size)) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["node"], pa.array([len(x) for x in sets], pa.int64()),
                                   pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "n", "shingles"])

    # A node has one key here, so its rows lie together after the join, and texts move once.
    rows = packed(texts).join(wanted, "key").dropDuplicates(["key", "node"]).select("node", "text")
    sets = written(rows.mapInArrow(read, "node long, n long, shingles binary"), "shingles")
    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))

    def similar(some: DataFrame) -> DataFrame:
        return some.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(
            _similar_pairs, "a long, b long")

    near = cut_lineage(similar(near))
    near = near if linked is None else near.union(linked)
    edges = near.union(similar(_apart(pairs, components(near))))
    if dense.isEmpty():
        return edges
    tiles = _tiles(_gathered(dense.join(sets.select("node", "n"), "node")), F.col("n") + 1, TILE)
    return edges.union(tiles.drop("n").join(sets.drop("n"), "node").repartition("t", "part").sortWithinPartitions("t", "part")
                       .mapInArrow(_similar_in_tiles, "a long, b long"))


def similar_classes(docs: DataFrame, size: int = WIDE_SHINGLE, fingerprints: bool = False) -> DataFrame:
    """doc_id, key, node and root of every row: rows with equal roots are similar to each other, by links; with `fingerprints`
    also by those of the operator. A node is a set of shingles."""

    key = document_key(docs["doc_id"], docs["text"]).alias("key")
    texts = docs.select(F.col("doc_id").cast("long"), key, F.col("text").cast("binary"))
    counts = shingle_counts(texts, size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches, "text"):
            sets = [np.unique(shingle_hashes(t, size)) for t in batch["text"].to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            prints = np.array([wide_print(x) for x in sets], np.uint64).view(np.int64)
            rare = [prefix(x, counts) if len(x) else x for x in sets]
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare).view(np.int64)))
            own = map(fingerprint, batch["text"].to_pylist()) if fingerprints else [0] * batch.num_rows
            fp = np.fromiter(own, np.uint64, batch.num_rows).view(np.int64)
            yield pa.record_batch([batch["doc_id"], batch["key"], *(pa.array(prints[:, k].copy()) for k in range(WIDE)),
                                   pa.array(nodes), lists, pa.array(fp)], names=["doc_id", "key", *WORDS, "node", "prefix", "fp"])

    schema = "doc_id long, key long, " + ", ".join(f"{c} long" for c in WORDS) + ", node long, prefix array<long>, fp long"
    prints = cut_lineage(texts.mapInArrow(read, schema))
    linked = _fingerprint_links(prints) if fingerprints else None
    roots = components(similar_links(prints, texts.select("key", "text"), size, linked))
    return prints.join(roots, "node", "left").select("doc_id", "key", "node", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, size: int = WIDE_SHINGLE, fingerprints: bool = False) -> DataFrame:
    """One row of every group of similar documents (see `similar_classes`), with all its columns: the smallest (doc_id, key),
    rows without an id last; repeated rows count once."""
    found = similar_classes(docs, size, fingerprints)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    of = lambda key, doc_id: F.struct(key.alias("key"), doc_id.cast("long").alias("doc_id")).alias("of")
    chosen = cut_lineage(found.groupBy("root").agg(F.min(order).alias("o")).select(
        of(F.col("o.key"), F.col("o.doc_id"))).distinct())
    # One column, in which NULL ids are equal: the rows are dealt out by it once, for the join and for the repeated rows.
    own = of(document_key(F.col("row.doc_id"), F.col("row.text")), F.col("row.doc_id")).alias("own")
    return with_row(docs).select("row", own).join(chosen, F.col("own") == F.col("of")).dropDuplicates(["of"]).select("row.*")
