"""Words of many texts at once, as arrays over one buffer of bytes.

A buffer holds the words of the texts one after the other, each followed by one blank; a text of a few dozen megabytes
costs a few times its size and no Python object per word.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = 0x20


def byte_table(separators: list[tuple[int, int]], lower: bool = False) -> np.ndarray:
    """For every byte what it becomes in the buffer: a blank if it lies in one of the ranges (given in ASCII, so all bytes of
    other characters are parts of words), itself otherwise, or its lower case."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A"):ord("Z") + 1] += 32
    kept = np.ones(256, bool)
    for first, last in separators:
        kept[first:last + 1] = False
    # `kept` is about bytes as they come in the text, before they are lowered.
    return np.where(kept, table, BLANK).astype(np.uint8)


@dataclass
class Words:
    """Word w is `data[starts[w]:ends[w]]`, and `data[ends[w]]` is a blank. Words of text t are those from `first[t]` up to
    before `first[t + 1]`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def codes(self) -> np.ndarray:
        """A number per word, the same for equal words of this buffer."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        offsets = np.append(self.starts, self.ends[-1] + 1)  # each word with its blank
        kind, width = (pa.large_binary(), np.int64) if offsets[-1] >= 2**31 else (pa.binary(), np.int32)
        words = pa.Array.from_buffers(
            kind, len(self.starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(self.data)])
        return pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)

    def joined(self, text: int) -> bytes:
        """Words of a text, joined by one blank."""
        low, high = self.first[text], self.first[text + 1]
        return self.data[self.starts[low]:self.ends[high - 1]].tobytes() if high > low else b""


def words_of(texts: list[bytes | None], table: np.ndarray) -> Words:
    """None has no words."""
    lengths = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b"\n".join(b"" if t is None else t for t in texts) + b"\n", np.uint8)
    data = table[raw]
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    data[bounds[1:len(texts) + 1] - 1] = BLANK
    inside = data != BLANK
    # A blank stays only behind a word.
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    place = np.zeros(len(bounds), np.int64)
    if len(texts):
        np.cumsum(np.add.reduceat(kept, bounds[:-1], dtype=np.int64), out=place[1:])
    data = data[kept]
    blanks = np.flatnonzero(data == BLANK)
    starts = np.concatenate([[0], blanks[:-1] + 1]).astype(np.int64) if len(blanks) else blanks
    first = np.searchsorted(starts, place)
    return Words(data, starts, blanks, first)
