"""Periodic runs against brute force over every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.corpora import WORD
from votescore.llm.runs import collapsed, find_runs, periodic_runs


def brute(words):
    """(start, length, period) of all runs, by the definition."""
    found, spans = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and (i, length) not in spans:
                found.append((i, length, q))
                spans.add((i, length))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def model(doc_id, text):
    """The row of a document in the query."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(frame):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                   for r in frame.collect()), key=str)


def together(texts):
    """Runs of several texts in one call, per text."""
    sizes = [len(t) for t in texts]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = find_runs(np.array([w for t in texts for w in t], np.int64), first)
    return [[(s - first[i], n, q) for s, n, q in found if first[i] <= s < first[i + 1]] for i in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=5), max_size=4))
def test_any_texts(parts):
    texts = [[w for block, times in text for w in block * times] for text in parts]
    assert together(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_long_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        text = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 5, 6, 18, 19, 57, 58, 120, 200]))]
            times = rng.choice([1, 3.9, 4, 4.1, 6])
            text += (block * 7)[:int(len(block) * times)]
        texts.append(text)
    assert together(texts) == [brute(t) for t in texts]


def test_thue_morse_and_fibonacci_words():
    """Texts with squares of every length, and no fourth power."""
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 3000:
        fibonacci, before = fibonacci + before, fibonacci
    assert together([thue, fibonacci, thue * 4]) == [brute(thue), brute(fibonacci), brute(thue * 4)]


def test_one_word_repeated_takes_no_square():
    assert together([[7] * 2_000_000]) == [[(0, 2_000_000, 1)]]


def test_rows_of_all_kinds(spark):
    # 45 and 46 get a repetition by the rule, if any of these does.
    data = [(i, f"w{i % 7} x y z " * (i % 9)) for i in range(60)] + [
        (None, "a a a a a a"), (3, None), (4, ""), (5, " \n\t\x0b"), (6, "é " * 6), (7, "A a " * 9), (7, "A a " * 9),
        (-8, "x" * 100_000 + " b" * 5), (2**62, "\x00 " * 7 + "\x1c\x85 " * 6)]
    docs = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in data], "doc_id long, text string, runs string, start int, length int, period int")
    want = sorted((model(*r) if r[0] is not None else (None, 1, 0, 6, 1, 6000, hashlib.sha256(b"0,6,1\n").hexdigest(),
                                                      hashlib.sha256(b"a").hexdigest()) for r in data), key=str)
    assert rows(periodic_runs(docs, plant=True)) == want
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in data)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "to be  or not " + "la la " * 5 + "end"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in collapsed(docs).collect()}
    assert found == {1: ("to be or not la end", [(4, 10, 1)]), 2: ("", [])}
