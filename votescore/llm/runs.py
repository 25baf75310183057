"""Periodic runs of words: stretches in which the words repeat at least four times, found by seed and extend on diagonals.

A run of period q and length n is a diagonal of the comparison of a text with itself: word i equals word i + q over n - q
words. Lags are taken in bands. In a band from `low` to `high` every run has at least 3 * low equal words in a row on
its diagonal (five for lag 1), the guaranteed overlap, and k-grams of that length are the seeds; k is at least `high`, so
inside a run the next place of a k-gram lies exactly one period on. So only places of a k-gram that follow each other in one
text are paired, as many pairs as words. A pair whose lag lies in the band is extended to both sides, word by word; a table
of how far each lag is covered lets later seeds of the same diagonal pass.

k-grams are compared exactly, by numbers given to those of the band before. Only k-grams that occur again in their text
go on to the next band, so ordinary text leaves after the first one.

NULL and texts without words have no run and an empty result. Repeated rows each have their row. Texts need no
exchange with each other: there is no shuffle, a text is one row's work, and an empty table gives an empty result. A NULL
doc_id has no checksum, so its text is looked at as it is.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import sliced
from votescore.llm.words import byte_table, words_of

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
WHITE_SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)])
_NO_PLACE = np.zeros(0, np.int64)


def bands(longest: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, k) for texts of at most `longest` words."""
    low, k = 1, LEAST_WORDS - 1
    while LEAST_PERIODS * low <= longest and longest >= LEAST_WORDS:
        yield low, k, k
        low = k + 1
        k = (LEAST_PERIODS - 1) * low


def _numbered(places: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places whose tuple of parts occurs more than once, and a number per tuple."""
    name = np.zeros(len(places), np.int64)
    for part in parts:
        if not len(places):
            break
        size = int(part.max()) + 1
        _, name, times = np.unique(name * size + part[places], return_inverse=True, return_counts=True)
        again = times[name] > 1
        places, name = places[again], name[again]
    return places, name


def _moved(part: np.ndarray, by: int) -> np.ndarray:
    """part[i + by] at i, 0 beyond the end: places that near the end of a text are sorted out before."""
    out = np.zeros_like(part)
    if by < len(part):
        out[:len(part) - by] = part[by:]
    return out


def _equal_from(codes: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a on equal those from b on, before b reaches end."""
    done, step = 0, 64
    while b + done < end:
        n = min(step, end - b - done)
        differs = codes[a + done:a + done + n] != codes[b + done:b + done + n]
        if differs.any():
            return done + int(differs.argmax())
        done, step = done + n, step * 4
    return done


def _equal_before(codes: np.ndarray, a: int, b: int, start: int) -> int:
    """How many words before a equal those before b, down to start."""
    done, step = 0, 64
    while a - done > start:
        n = min(step, a - done - start)
        differs = (codes[a - done - n:a - done] != codes[b - done - n:b - done])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, step = done + n, step * 4
    return done


def find_runs(codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts whose words lie one after the other; `first` as in Words. Starts
    count from the first word of all, and the list ascends by start and period."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = first[1:][text] if len(text) else _NO_PLACE
    found: list[tuple[int, int, int]] = []
    places = np.arange(len(codes))
    grams = np.zeros(0, np.int64)  # number of the gram that begins at a place, -1 if it does not occur again
    for low, high, k in bands(int(sizes.max(initial=0))):
        if k == LEAST_WORDS - 1:
            places = places[places + k <= end]
            if not len(places):
                break
            places, name = _numbered(places, text * (int(codes.max()) + 1) + codes, *(_moved(codes, i) for i in range(1, k)))
        else:
            known = low - 1  # the length of the grams of the band before
            at = [0, known, 2 * known, k - known]
            places = places[places + k <= end[places]]
            for by in at[1:]:
                places = places[grams[places + by] >= 0]
            places, name = _numbered(places, *(_moved(grams, by) for by in at))
        if not len(places):
            break
        grams = np.full(len(codes), -1, np.int64)
        grams[places] = name

        order = np.lexsort((places, name))
        here, there = places[order][:-1], places[order][1:]
        lag = there - here
        seeds = (name[order][:-1] == name[order][1:]) & (lag >= low) & (lag <= high)
        here, lag = here[seeds], lag[seeds]
        by_place = np.argsort(here, kind="stable")
        covered: dict[int, int] = {}
        for i, q in zip(here[by_place].tolist(), lag[by_place].tolist()):
            if i < covered.get(q, 0):
                continue
            right = i + _equal_from(codes, i, i + q, int(end[i]))
            left = i - _equal_before(codes, i, i + q, int(first[text[i]]))
            covered[q] = right
            length = right - left + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((left, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def planted(doc_id: int | None, words: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that the test gives to a tenth of the documents."""
    if doc_id is None or not words:
        return None
    tenth, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    start = tenth % words
    return start, 1 + (words - start) // (3 + tenth % 8)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(),
          "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
_COLLAPSED = {"doc_id": pa.int64(), "runs": pa.list_(_RUN), "text": pa.string()}


def _rows(doc_ids: list[int | None], texts: list[bytes | None], plant: bool) -> Iterator[tuple]:
    words = words_of(texts, WHITE_SPACE)
    source = np.arange(len(words.starts))
    changed = set()
    for t, doc_id in enumerate(doc_ids):
        low, high = int(words.first[t]), int(words.first[t + 1])
        repeat = planted(doc_id, high - low) if plant else None
        if repeat is not None:
            at, period = low + repeat[0], repeat[1]
            source[at:high] = at + np.arange(high - at) % period
            changed.add(t)
    runs = find_runs(words.codes()[source], words.first)
    starts = np.array([r[0] for r in runs], np.int64)
    bounds = np.searchsorted(starts, words.first)
    for t, doc_id in enumerate(doc_ids):
        low, high = int(words.first[t]), int(words.first[t + 1])
        mine = [(s - low, n, q) for s, n, q in runs[bounds[t]:bounds[t + 1]]]
        if mine or t in changed:
            kept = np.ones(high - low, bool)
            for s, n, q in mine:
                kept[s + q:s + n] = False
            left = source[low:high][kept]
            collapsed = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[left].tolist(), words.ends[left].tolist()))
        else:
            collapsed = words.joined(t)
        best = max(mine, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
        yield (doc_id, high - low, len(mine), *best, None if best[0] is None else 1000 * best[1] // best[2],
               hashlib.sha256(listed.encode()).hexdigest(), mine, collapsed)


def _mapped(docs: DataFrame, shape: dict[str, pa.DataType], schema: str, pick: Callable[[tuple], tuple], plant: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = [pick(r) for r in _rows(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), plant)]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), shape.values())], names=list(shape))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row doc_id, n_words, n_runs, start, length, period and exponent_milli of its longest run (the earliest, then the
    one of the smallest period, of several), and digests of the list of runs and of the text without repetitions. With `plant`
    a tenth of the documents get a repetition first, by a rule on their doc_id."""
    schema = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _FOUND.items())
    return _mapped(docs, _FOUND, schema, lambda r: (*r[:8], hashlib.sha256(r[9]).hexdigest()), plant)


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period) and the text with one period left of every run, its words joined by blanks."""
    return _mapped(docs, _COLLAPSED, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string",
                   lambda r: (r[0], [dict(zip(("start", "length", "period"), x)) for x in r[8]], r[9].decode(errors="replace")), False)
