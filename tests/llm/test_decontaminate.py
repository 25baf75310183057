"""Decontamination against brute force over all windows."""

import hashlib
import random
import re

import pytest

from votescore.llm.decontaminate import Patterns, contaminated_documents, contamination, windows
from votescore.llm.words import words_of
from votescore.llm.decontaminate import NOT_WORDS

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def model(text, benchmark):
    """(n_words, hit word numbers, items) by comparing every place with every window."""
    mine, hit, items = words(text), set(), set()
    places = {}
    for size in range(1, 11):
        for i in range(len(mine) - size + 1):
            places.setdefault(tuple(mine[i:i + size]), []).append(i)
    for item, body in benchmark:
        theirs = words(body)
        if item is None or not theirs:
            continue
        for j in range(max(1, len(theirs) - 9)):
            window = tuple(theirs[j:j + 10])
            for i in places.get(window, []):
                hit.update(range(i, i + len(window)))
                items.add(item)
    return len(mine), hit, items


def model_row(doc_id, text, benchmark):
    n, hit, items = model(text, benchmark)
    return doc_id, n, len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


def corpus(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("aBé0") for _ in range(rng.randint(1, 9))) for _ in range(4 if seed % 3 == 0 else 80)]
    prose = lambda n: "".join(rng.choice(names) + rng.choice([" ", "\n", ", ", " -- ", "@", "\x00"]) for _ in range(n))
    benchmark = [(i, prose(rng.choice([0, 1, 2, 9, 10, 11, 40]))) for i in range(12)]
    benchmark += [(50, benchmark[3][1]), (51, benchmark[11][1].upper()), (None, "aB aB"), (52, None), (7, benchmark[5][1])]
    docs = []
    for i in range(60):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(benchmark)[1] or "").split(" ")
            text += " ".join(part[rng.randint(0, 3):]) + prose(rng.randint(0, 20))
        docs.append((i, text))
    docs += [(3, docs[3][1]), (4, None), (None, docs[9][1]), (61, ""), (62, "é" * 70_000 + " " + (benchmark[2][1] or ""))]
    return docs, benchmark


@pytest.mark.parametrize("seed", range(6))
def test_search(seed):
    docs, benchmark = corpus(seed)
    items_of = {}
    for item, text in benchmark:
        if item is not None:
            for w in set(windows((text or "").encode())):
                items_of.setdefault(w, []).append(item)
    found = Patterns(items_of).search(words_of([None if t is None else t.encode() for _, t in docs], NOT_WORDS))
    for (_, text), (spans, items) in zip(docs, found):
        _, hit, want = model(text, benchmark)
        assert {w for a, b in spans for w in range(a, b)} == hit and set(items) == want


@pytest.mark.parametrize("block_windows", [200_000, 25])
def test_rows(spark, block_windows, monkeypatch):
    docs, benchmark = corpus(1)
    clash = "doc_id long, text string, spans int, key int, items int, block string"
    frame = spark.createDataFrame([(*d, 1, 2, 3, "b") for d in docs], clash)
    bench = spark.createDataFrame([(*b, 0) for b in benchmark], "item_id long, text string, doc_id int")
    found = contamination(frame, bench, block_windows).collect()
    got = sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], sorted(r.items)) for r in found)
    want = []
    for d, t in docs:
        n, hit, items = model(t, benchmark)
        edges = sorted(hit)
        spans = [(a, next(e for e in range(a, n + 2) if e not in hit)) for a in edges if a - 1 not in hit]
        want.append((str(d), n, spans, sorted(items)))
    assert got == sorted(want)


def test_digests_and_empty_tables(spark):
    docs, benchmark = corpus(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(benchmark, "item_id long, text string")
    got = sorted(map(tuple, contaminated_documents(frame, bench).collect()), key=str)
    assert got == sorted((model_row(d, t, benchmark) for d, t in docs), key=str)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    assert contaminated_documents(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in contaminated_documents(frame, bench.limit(0)).collect())


def test_a_frequent_window_of_one_word(spark):
    """An item of one word that is every word of a long text."""
    frame = spark.createDataFrame([(1, "the " * 200_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The"), (2, "the the")], "item_id long, text string")
    row = contamination(frame, bench).first()
    assert (row.n_words, [tuple(s) for s in row.spans], row["items"]) == (200_000, [(0, 200_000)], [1, 2])
