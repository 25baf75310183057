"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Only the *lengths* decide a packing, and there are at most `capacity` of them. So the plan is made from a histogram of
lengths (capacity + 1 numbers, whatever the corpus holds), and every piece finds its place in the plan by its length
and its rank among the pieces of that length. Ranks need no group in one task: a piece is numbered within its input
partition while it is tokenized, and partitions are offset by prefix sums over (partition, length) counts.

The plan matches large items first. Of pieces above one third of the capacity at most two fit into a sequence; each
piece above one half takes the largest such partner that fits, from the largest piece down, which gives as many
pairs as can be (the sets of partners are nested). What is left above one third pairs among itself. Smaller pieces
go, from the largest down, into the tightest gap that holds them.

A NULL or empty text is the end token alone. Documents longer than the capacity are cut into full pieces and a rest.
Repeated rows and shared or NULL ids are packed row by row. An empty table gives an empty result.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votescore.llm.common import sliced
from votescore.session import cut_lineage

CAPACITY = 4096
END = 1
#: Entries of one generation of the word cache; two generations are held.
CACHE = 150_000
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)[!-/:-@\[-`{-~]*")
#: Byte-level vocabularies show the bytes 0x80 to 0xA0 and 0xAD, which are no printable characters, as U+0122 on.
_SHOWN = {byte: 0x122 + i for i, byte in enumerate([*range(0x7F, 0xA1), 0xAD], -1)}


class WordTokens:
    """Ids of blank-separated stretches of text as little-endian 32-bit bytes.

    The tokenizer normalises white space and never merges across it, so a stretch has the same ids wherever it stands.
    A-Z are lower-cased before the lookup, which the tokenizer would do next. Of a new stretch the tokenizer does all,
    except that a word of Latin small letters, which no normalisation changes, goes straight to its merges; what
    punctuation follows is a token group of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Names of special tokens are theirs exactly as written, before anything is normalised; texts are cut at them. What is
        # left holds none, and must not get one by lower case.
        self.special = {t.content.encode(): np.array([i], "<u4").tobytes()
                        for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")").split
        self.tokenizer.encode_special_tokens = True
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _learn(self, stretches: set[bytes]) -> None:
        missing = []
        for s in stretches:
            if (known := self.old.get(s)) is not None:
                self.young[s] = known
            elif plain := _PLAIN.fullmatch(word := s.decode()):
                letters = plain[1] if plain[1].isascii() else plain[1].encode().decode("latin-1").translate(_SHOWN)
                ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
                self.young[s] = ids + self._punctuation(word[plain.end(1):])
            else:
                missing.append(s)
        for at in range(0, len(missing), 20_000):
            part = missing[at:at + 20_000]
            coded = self.tokenizer.encode([s.decode() for s in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part))
            ends = (np.cumsum(counts) * 4).tolist()
            self.young.update(zip(part, [ids[a:b] for a, b in zip([0, *ends], ends)]))

    def _punctuation(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > CACHE:
                self.marks.clear()
            self.marks[text] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.marks[text]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text."""
        cut = [self.cut(t) if t and any(name in t for name in self.special) else [t] for t in texts]
        plain = iter(self._encode([part for parts in cut for part in parts[::2]]))
        return [b"".join(self.special[part] if i % 2 else next(plain) for i, part in enumerate(parts)) for parts in cut]

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {b"": b""}
        split = [(t or b"").translate(_BLANK).lower().split(b" ") for t in texts]
        self._learn(set().union(*split).difference(self.young))
        return [b"".join(map(self.young.__getitem__, s)) for s in split]


_tokenizers: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; nth counts the pieces of the same length in the same input partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _tokens(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        end = np.array([END], "<u4").tobytes()
        for batch in sliced(batches, "text"):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), part, seen[length])
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, PIECES)


class Plan:
    """Rules (length, first item, items per bin, first bin, offset): the items of a length from `first item` on
    fill consecutive bins from `first bin` on, so many in each, one behind the other from `offset` on."""

    def __init__(self, counts: list[int], capacity: int):
        self.capacity, self.left = capacity, np.array(counts, np.int64)
        self.used = np.zeros(capacity + 1, np.int64)
        self.rules: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.open = np.zeros(capacity + 1, bool)
        self.bins = 0
        self._match_large()
        self._fill_small()

    def _put(self, length: int, per_bin: int, first_bin: int, bins: int, offset: int) -> None:
        self.rules.append((length, int(self.used[length]), per_bin, first_bin, offset))
        self.used[length] += per_bin * bins
        self.left[length] -= per_bin * bins

    def _new(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def _leave(self, gap: int, first_bin: int, bins: int) -> None:
        if gap and bins:
            self.gaps.setdefault(gap, []).append((first_bin, bins))
            self.open[gap] = True

    def _match_large(self) -> None:
        c, third = self.capacity, self.capacity // 3
        for a in range(c, third, -1):
            while n := int(self.left[a]):
                if 2 * a <= c and n > 1:  # any two of the rest fit together
                    bins = self._new(n // 2)
                    self._put(a, 2, bins, n // 2, 0)
                    self._leave(c - 2 * a, bins, n // 2)
                    continue
                fits = np.flatnonzero(self.left[third + 1:min(c - a, a - 1) + 1])
                both = min(n, int(self.left[b])) if len(fits) and (b := third + 1 + int(fits[-1])) else n
                bins = self._new(both)
                self._put(a, 1, bins, both, 0)
                if len(fits):
                    self._put(b, 1, bins, both, a)
                self._leave(c - a - (b if len(fits) else 0), bins, both)

    def _fill_small(self) -> None:
        for length in range(self.capacity // 3, 0, -1):
            while n := int(self.left[length]):
                if self.open[length:].any():
                    gap = length + int(np.argmax(self.open[length:]))
                    first, bins = self.gaps[gap].pop()
                    self.open[gap] = bool(self.gaps[gap])
                else:
                    gap, bins = self.capacity, -(-n // (self.capacity // length))
                    first = self._new(bins)
                per_bin = min(gap // length, n)
                full = min(bins, n // per_bin)
                self._put(length, per_bin, first, full, self.capacity - gap)
                self._leave(gap - per_bin * length, first, full)
                first, bins, n = first + full, bins - full, n - per_bin * full
                if bins and n:  # fewer than per_bin are left for one more bin
                    self._put(length, n, first, 1, self.capacity - gap)
                    self._leave(gap - n * length, first, 1)
                    first, bins = first + 1, bins - 1
                self._leave(gap, first, bins)

    def place(self) -> "Placement":
        return Placement(np.array(sorted(self.rules), np.int64).reshape(-1, 5))


class Placement:
    def __init__(self, rules: np.ndarray):
        self.rules = rules
        self.first = np.searchsorted(rules[:, 0], np.arange(rules[:, 0].max(initial=0) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the rank-th item of each length."""
        at = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for value, rows in zip(values, np.split(order, starts[1:])):
            low, high = self.first[value], self.first[value + 1]
            at[rows] = low + np.searchsorted(self.rules[low:high, 1], rank[rows], "right") - 1
        _, item, per_bin, first_bin, offset = self.rules[at].T
        nth = rank - item
        return first_bin + nth // per_bin, offset + nth % per_bin * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The pieces (without their ids) are checkpointed, because their numbering must not be made twice. They are gathered
    first, so that their files follow their size and not the number of input partitions: on a local disk each file starts
    two helper processes. Pieces numbered together stay together, whichever attempt of a task numbered them.
    """
    cut = cut_lineage(pieces(docs, tokenizer, capacity).repartition("part", "length"))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = Plan([by_length.get(i, 0) for i in range(capacity + 1)], capacity).place()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch["length"].to_numpy()
            bin_, offset = place(length, batch["rank"].to_numpy())
            yield pa.record_batch(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bin_), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")
