"""Removal of repeated passages: prefix-partitioned suffix trees.

A window is 20 consecutive words. A word goes if a window covers it whose word sequence starts earlier as well
(smaller doc_id, or same document and earlier start); windows are judged on the input.

A tree of all suffixes does not fit anywhere, so the suffixes are split by prefixes into groups that do:

1. Every window names an *anchor*, the smallest of the hashes of the 8-word grams in it (the leftmost of equals).
   Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text has
   about one anchor per seven words. Anchors that occur once in the corpus have no repeat below them and end here.
2. An occurrence of a repeated anchor stands for up to 13 suffixes, one per window that names it, and is sent as
   one stretch of words. Anchors with at most `GROUP` occurrences are prefixes as they are. Those with more are
   lengthened to the whole window: all suffixes below such a prefix are equal down to the depth that matters, so
   only the earliest of each is needed: a task sends one for each few megabytes of text, and one is held where they
   meet.
3. For each group its subtree is built in memory as sorted suffixes; neighbours that share 20 words lie below one
   internal node of that depth, whose earliest leaf is the first occurrence.
4. First occurrences go back to their documents. A window with a repeated anchor that is no first is a repeat.

Groups are bounded by GROUP stretches; the join with counts is an ordinary one whose hot keys the planner may split;
what a document gets back is bounded by its own length. Word sequences are compared as words; only for lengthened
prefixes two 64-bit hashes stand for them.

NULL text has no words. Repeated rows (same doc_id and text) are one document and lose the same words. Different
texts under one doc_id, and NULL ids (which come first), are ordered by a hash of the text. An empty table gives an
empty result.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import document_key, packed, replaced_text, sliced, unpacked, with_row, written
from votescore.session import cut_lineage

WINDOW = 20
GRAM = 8
#: Most occurrences of a prefix that form a group; at most 13 suffixes each.
GROUP = 2000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LONG = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: where they start and end in the joined bytes, and the words of each text."""

    def __init__(self, texts: list[bytes | None]):
        self.data = b"\n".join(t or b"" for t in texts) + b"\n" + bytes(8)
        raw = np.frombuffer(self.data, np.uint8)
        blank = _BLANK[raw[:-8]]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits per word, from its bytes in steps of eight."""
        length = self.end - self.start
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = _mix(length.astype(np.uint64) + np.uint64((seed + 1 << 32) + seed))
        active = np.flatnonzero(length <= _LONG)
        at = 0
        while len(active):
            rest = length[active] - at
            value = lanes[self.start[active] + at]
            short = rest < 8
            value[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[active] = _mix((h[active] ^ value) * _ODD + np.uint64(at + 1))
            active, at = active[rest > 8], at + 8
        for i in np.flatnonzero(length > _LONG):
            digest = hashlib.blake2b(self.data[self.start[i]:self.end[i]], digest_size=8, salt=bytes([seed])).digest()
            h[i] = int.from_bytes(digest, "little")
        return h

    def rolled(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on."""
        n = max(0, len(hashes) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * _ODD + hashes[k:k + n]
        return _mix(h)

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor hash of every run of windows with the same anchor."""
        n = len(self.start) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = self.rolled(self.hashes(), GRAM)
        least, place = grams[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, WINDOW - GRAM + 1):
            other = grams[k:k + n]
            place[other < least] = k
            np.minimum(least, other, out=least)
        window = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1:])
        anchor = window + place[window]
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        return window[new], np.diff(new, append=len(window)), grams[anchor[new]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, key, n: the anchors of each document once, with the number of their occurrences in it."""
    for batch in sliced(batches, "text"):
        words = Words(batch["text"].to_pylist())
        window, _, anchor = words.anchored()
        order = np.lexsort((anchor, words.text[window]))
        text, anchor = words.text[window][order], anchor[order]
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | np.concatenate(([True], anchor[1:] != anchor[:-1]))[:len(anchor)])
        keys = batch["key"].to_numpy()
        yield pa.record_batch(
            [pa.array(anchor[new].view(np.int64)), pa.array(keys[text[new]]), pa.array(np.diff(new, append=len(anchor)))],
            names=["anchor", "key", "n"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The structs of a list column and the row of each."""
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)


def _repeated(words: Words, marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchor is repeated: first window, windows, anchor, and whether its prefix is lengthened."""
    window, count, anchor = words.anchored()
    text = words.text[window]
    of, known = _flat(marks)
    if not len(of) or not len(window):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    value = known.field("anchor").to_numpy().view(np.uint64)
    long = known.field("long").to_numpy(zero_copy_only=False)
    # Pairs (text, anchor) as ranks of anchors that are equal, so that one number stands for a pair.
    both, rank = np.unique(np.concatenate((value, anchor)), return_inverse=True)
    code = np.concatenate((of, text)) * len(both) + rank
    order = np.argsort(code[:len(of)])
    listed = code[:len(of)][order]
    at = np.minimum(np.searchsorted(listed, code[len(of):]), len(listed) - 1)
    found = listed[at] == code[len(of):]
    return window[found], count[found], anchor[found], long[order][at][found]


STRETCHES = "prefix long, extension long, words binary, doc_id long, key long, pos int"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes below repeated prefixes. Equal ones of one batch are sent once, the earliest."""
    for batch in sliced(batches, "text"):
        words = Words(unpacked(batch["text"].to_pylist()))
        window, count, anchor, long = _repeated(words, batch["marks"])
        ids, keys = batch["doc_id"].to_pylist(), batch["key"].to_pylist()
        prefix = anchor.view(np.int64)
        first = words.first
        best: dict[tuple, tuple] = {}

        def offer(what: tuple, i: int) -> None:
            t = int(words.text[i])
            place = (ids[t] is not None, ids[t] or 0, keys[t], i - int(first[t]))
            if (held := best.get(what)) is None or place < held:
                best[what] = place

        start, end, data = words.start, words.end, words.data
        for w, c, p in zip(window[~long].tolist(), count[~long].tolist(), prefix[~long].tolist()):
            offer((p, 0, b" ".join(data[start[w]:end[w + c + WINDOW - 2]].split())), w)
        if long.any():
            extension = words.rolled(words.hashes(1), WINDOW).view(np.int64)
            full = words.rolled(words.hashes(2), WINDOW).view(np.int64)
            for w, c in zip(window[long].tolist(), count[long].tolist()):
                for i in range(w, w + c):
                    offer((int(full[i]), int(extension[i]), None), i)
        if best:
            what, place = zip(*best.items())
            columns = [*zip(*what), [p[1] if p[0] else None for p in place], [p[2] for p in place], [p[3] for p in place]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds)],
                                  names=["prefix", "extension", "words", "doc_id", "key", "pos"])


FIRSTS = "doc_id long, key long, pos int, windows int"


def _firsts(groups: list[tuple]) -> Iterator[tuple]:
    """First occurrences in whole groups of (prefix, extension, words, doc_id, key, pos).

    The leaves of the subtrees are the suffixes in sorted order, cut at the depth of a window. Leaves with the same
    20 words follow each other, the earliest first; bit i of `windows` says that the window i words after pos is one.
    A lengthened prefix is one such leaf, and its extension stands for the words.
    """
    leaves = []
    for row, (prefix, extension, stretch, doc_id, key, pos) in enumerate(groups):
        if stretch is None:
            leaves.append((prefix, str(extension).encode(), doc_id is not None, doc_id or 0, key, pos, row, 0))
            continue
        words = stretch.split(b" ")
        for i in range(len(words) - WINDOW + 1):
            leaves.append((prefix, b" ".join(words[i:i + WINDOW]), doc_id is not None, doc_id or 0, key, pos + i, row, i))
    leaves.sort()
    bits = [0] * len(groups)
    node = None
    for leaf in leaves:
        if leaf[:2] != node:
            node = leaf[:2]
            bits[leaf[6]] |= 1 << leaf[7]
    return ((*g[3:], b) for g, b in zip(groups, bits) if b)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix and extension; groups are never cut. Of a lengthened prefix only the earliest row is held,
    so a group is at most GROUP stretches, whatever the corpus repeats."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*_firsts(rows))) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "key", "pos", "windows"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("prefix", "extension", "words", "doc_id", "key", "pos"))):
            if row[2] is None and held and held[-1][:3] == row[:3]:
                held[-1] = min(held[-1], row, key=lambda r: (r[3] is not None, r[3] or 0, *r[4:]))
            else:
                held.append(row)
        if len(held) < GROUP:
            continue
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield batch_of(held[:cut])
            held = held[cut:]
    if held:
        yield batch_of(held)


def removed_words(words: Words, batch: pa.RecordBatch) -> np.ndarray:
    """Words covered by a window that is a repeat."""
    window, count, _, _ = _repeated(words, batch["marks"])
    repeat = np.zeros(len(words.start) + WINDOW, bool)
    repeat[np.repeat(window - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())] = True
    of, first = _flat(batch["firsts"])
    if len(of):
        mine, theirs = batch["doc_id"].take(pa.array(of)), first.field("doc_id")
        same = pc.fill_null(pc.equal(mine, theirs), False).to_numpy(zero_copy_only=False) | (
            pc.is_null(mine).to_numpy(zero_copy_only=False) & pc.is_null(theirs).to_numpy(zero_copy_only=False))
        base, bits = words.first[of] + first.field("pos").to_numpy(), first.field("windows").to_numpy()
        for i in range(WINDOW - GRAM + 1):
            repeat[base[same & (bits >> i & 1 == 1)] + i] = False
    starts = np.flatnonzero(repeat)
    cover = np.zeros(len(words.start) + 2 * WINDOW, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.cumsum(cover)[:len(words.start)] > 0


def _results(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Per document: counts and digest, or the text without the removed words and the blanks behind them."""
    for batch in sliced(batches, "text"):
        texts = unpacked(batch["text"].to_pylist())
        marked = batch["marks"].is_valid().to_pylist()
        words = Words([text if m else None for text, m in zip(texts, marked)])  # the others lose nothing
        gone = removed_words(words, batch)
        begins = np.concatenate(([0], np.cumsum(gone)))
        n_removed = begins[words.first[1:]] - begins[words.first[:-1]]
        n_words, output = [], []
        for text, a, b, removed in zip(texts, words.first[:-1].tolist(), words.first[1:].tolist(), n_removed.tolist()):
            if whole:
                if removed:
                    edge = np.flatnonzero(np.diff(gone[a:b], prepend=True, append=True)) + a  # kept runs: begin, end
                    lead = len(text) - len(text.lstrip(b" \t\n\x0b\x0c\r"))
                    at = (words.start[np.minimum(edge, len(words.start) - 1)] - (int(words.start[a]) - lead)).tolist()
                    text = text[:lead] + b"".join(
                        text[x:y if e < b else None] for x, y, e in zip(at[0::2], at[1::2], edge[1::2].tolist()))
                output.append(text)
            else:
                kept = (text or b"").split()
                n_words.append(len(kept))
                if removed:
                    kept = [kept[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
                output.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        if whole:
            text = pa.array(output, pa.binary()).cast(pa.string())
            yield pa.record_batch([batch["row"], text], names=["row", "text"])
        else:
            yield pa.record_batch([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed), pa.array(output, pa.string())],
                                  names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _judged(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, key, packed text, more..., marks (repeated anchors of the document) and firsts (its first occurrences).

    One plan from the prefix counts on: the texts are dealt by key once, and both joins read that exchange.
    """
    anchors = written(docs.select("key", "text").mapInArrow(_anchors, "anchor long, key long, n long"), "anchors")
    prefixes = cut_lineage(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
                           .select("anchor", (F.col("n") > GROUP).alias("long")))
    marks = (anchors.select("anchor", "key").join(prefixes, "anchor").groupBy("key")
             .agg(F.collect_set(F.struct("anchor", "long")).alias("marks")))
    marked = packed(docs.select("doc_id", "key", "text", *more)).repartition("key").join(marks, "key", "left")
    sent = (marked.where("marks is not null").select("doc_id", "key", "text", "marks")
            .mapInArrow(_stretches, STRETCHES))
    trees = (sent.repartition("prefix").sortWithinPartitions("prefix", "extension", F.col("words").isNull())
             .mapInArrow(_subtrees, FIRSTS))
    firsts = trees.groupBy("key").agg(
        F.collect_list(F.struct("doc_id", "pos", "windows")).alias("firsts"))
    return marked.join(firsts, "key", "left")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    keyed = docs.select(F.col("doc_id").cast("long"), document_key(docs["doc_id"], docs["text"]).alias("key"),
                        F.col("text").cast("binary"))
    return _judged(keyed).select("doc_id", "text", "marks", "firsts").mapInArrow(
        partial(_results, whole=False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """All rows and columns, with text (and n_chars, if there) without the repeated words."""
    keyed = with_row(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), document_key(F.col("row.doc_id"), F.col("row.text")).alias("key"),
        F.col("row.text").cast("binary").alias("text"),
        F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    judged = _judged(keyed, "row").select("doc_id", "row", "text", "marks", "firsts")
    kept = judged.mapInArrow(partial(_results, whole=True), judged.select("row", F.col("text").cast("string")).schema)
    return kept.select(replaced_text(docs, F.col("text")))
