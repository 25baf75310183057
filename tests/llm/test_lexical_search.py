"""Ranked search against brute force over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from votescore.llm import lexical_search
from votescore.llm.lexical_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def model(docs, items, k=10):
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    number, total = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        if text is not None:
            wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, held in wanted.items():
        scores = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * number // total
            scores.append((-sum(math.floor(1000 * math.log((2 * number + 2) / (2 * holding[t] + 1))) * (
                1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in held if c[t]), -math.inf if d is None else d))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, i + 1, None if d == -math.inf else d, -s) for i, (s, d) in enumerate(best)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("aBé0") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    prose = lambda n: "".join(rng.choice(names) + rng.choice([" ", "\n", ", ", "@", "\x00"]) for _ in range(n))
    docs = [(i, prose(rng.choice([0, 1, 5, 50, 300]))) for i in range(80)]
    docs += [(7, docs[7][1]), (81, docs[9][1]), (None, docs[10][1]), (82, None), (83, "-- !"), (84, "x" * 3_000_000 + " a"), (-3, docs[10][1])]
    items = [(i, prose(rng.choice([0, 1, 4, 30]))) for i in range(15)] + [(3, "another a"), (20, None), (21, "nowhere else"), (None, "a")]
    return docs, items


@pytest.mark.parametrize("seed,block_postings", [(1, 2_000_000), (2, 40)])
def test_rankings(spark, seed, block_postings, monkeypatch):
    monkeypatch.setattr(lexical_search, "_CELLS", 64)
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, n int, terms int, item_id string").repartition(7)
    wanted = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    found = ranked(frame, wanted, k=4, block_postings=block_postings).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, found.collect()), key=str) == model(docs, items, 4)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "_PIECE", 16)
    text = " ".join(f"w{i}" * (i % 9) for i in range(200))
    assert [t.decode() for piece in lexical_search.terms(text.encode()) for t in piece] == split(text)
