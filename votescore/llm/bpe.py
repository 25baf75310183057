"""Byte-level BPE encoding and decoding in linear time.

A text is split by a pattern and every match is encoded by itself. The bytes of a match are read as Latin-1, so that an
Aho-Corasick automaton over the vocabulary (one character per byte) gives the longest token from every place in one
pass. From left to right the longest token is taken; if it doesn't go with the token before it, its longest prefix that is
a token is tried, and if none goes, the token before is taken back and its end marked as no border. Two tokens go
together if merging their bytes gives just these two, which is found by undoing their merges and memoised. A sequence
in which all neighbours go together is the one that merging produces, and a place that was once marked is never tried
again, so time is linear.

A match that is a token itself is that token, as with the library whose ids these are. Vocabulary entries that merging
never makes take no part otherwise.

NULL and empty texts have no tokens. Repeated rows and shared or NULL ids are encoded row by row.
"""

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import sliced

#: Matches held in one generation of the cache, and the longest that are held; two generations are kept.
CACHE = 200_000
LONGEST = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Encodes matches of the pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = set()
        for token, rank in ranks.items():
            parts = self.merged(token, until=2)
            if len(parts) == 1 or (len(parts) == 2 and len(token) >= 2 and self.merged(token) == [rank]):
                self.made.add(rank)
                if len(parts) == 2:
                    self.parts[rank] = tuple(parts)
        #: The longest proper prefix that is a token.
        self.shorter = {rank: next((r for k in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:k])) in self.made), None)
                        for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for rank in self.made:
            self.automaton.add_word(self.token[rank].decode("latin-1"), (len(self.token[rank]), rank))
        self.automaton.make_automaton()

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Plain merging: again and again the leftmost of the lowest-ranked pairs. For vocabulary entries only."""
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in found if r is not None]
            if not known:
                break
            i = found.index(min(known))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between a and b.

        Back from the end, the later of the merges that made what stands at the border is undone. The two parts that
        then meet there must not have a merge that would have come before the one undone; of equal ranks the left
        one comes first.
        """
        ranks, token, parts = self.ranks, self.token, self.parts
        limit = len(token) + 1
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < limit:
                return False
            if a in parts and (a > b or b not in parts):
                limit, a = a, parts[a][1]
            elif b in parts:
                limit, b = b + 1, parts[b][0]
            else:
                return True

    def encode(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        size = len(data)
        longest = [0] * (size + 1)
        for last, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[last - length + 1] = rank  # later matches from the same place are longer
        border = [True] * (size + 1)
        pairs, shorter, lengths = self.pairs, self.shorter, self.length
        if len(pairs) > 4 * CACHE:
            pairs.clear()
        out: list[int] = []
        at, rank, last = 0, longest[0], None
        while at < size:
            end = at + lengths[rank]
            if border[end]:
                if last is None:
                    fits = True
                elif (fits := pairs.get((last, rank))) is None:
                    fits = pairs[last, rank] = self._apart(last, rank)
                if fits:
                    out.append(rank)
                    at, last, rank = end, rank, longest[end]
                    continue
            rank = shorter[rank]
            if rank is None:
                # The token before is taken back; it ends at a marked place now, so its prefixes are next.
                border[at] = False
                rank = out.pop()
                at -= lengths[rank]
                last = out[-1] if out else None
        return tuple(out)


class Matches(dict):
    """Ids by match."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.old.get(match)
        if ids is None:
            ids = self.merges.encode(match.encode())
        if len(match) <= LONGEST:
            if len(self) > CACHE:
                self.old = dict(self)
                self.clear()
            self[match] = ids
        return ids


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.matches = Matches(Merges(ranks))
        size = max(ranks.values(), default=-1) + 1
        self.bytes = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.matches.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(read_ranks(path), pattern)
    return _tokenizers[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row. The vocabulary is a file that every worker has at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode
        for batch in sliced(batches, "text"):
            ids = [encode(text or "") for text in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(frame: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(path, pattern).decode
        for batch in batches:
            data = [decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to. Ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        name = [str(i) for i in range(len(coder.bytes))]
        for batch in sliced(batches, "text"):
            counts, ids_digest, text_digest = [], [], []
            for text in batch["text"].to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                text_digest.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()),
                 pa.array(text_digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
