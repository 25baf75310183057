import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from votescore.llm import packing
from votescore.llm.packing import Plan, WordTokens, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [7, 12, 30, 4096])
def test_plan_places_every_item_without_gaps(capacity):
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [min(capacity, int(rng.paretovariate(0.8))) if rng.random() < .6 else rng.randint(1, capacity)
                   for _ in range(rng.choice([0, 1, 5, 60, 400]))]
        plan = Plan(np.bincount(lengths, minlength=capacity + 1).tolist(), capacity)
        assert not plan.left.any()
        if not lengths:
            continue
        seen, ranks = {}, []
        for n in lengths:
            ranks.append(seen.get(n, 0))
            seen[n] = ranks[-1] + 1
        bins = {}
        for n, b, o in zip(lengths, *plan.place()(np.array(lengths), np.array(ranks))):
            bins.setdefault(b, []).append((o, n))
        for items in bins.values():
            at = 0
            for o, n in sorted(items):
                assert o == at
                at += n
            assert at <= capacity
        least = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
        assert len(bins) <= least * 11 / 9 + 1


def test_large_items_are_matched_as_often_as_possible():
    for seed in range(200):
        rng = random.Random(seed)
        items = [rng.randint(11, 30) for _ in range(rng.randint(1, 9))]  # above a third of 30
        plan = Plan(np.bincount(items, minlength=31).tolist(), 30)

        def fewest(left):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return 1 + min([fewest(rest)] + [fewest(rest[:i] + rest[i + 1:]) for i, b in enumerate(rest) if a + b <= 30])

        assert plan.bins == fewest(sorted(items, reverse=True))


def test_words_have_the_ids_of_the_text(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    tokenizer = Tokenizer.from_file(PATH)  # as it is: names of special tokens in a text are special
    rng = random.Random(1)
    texts = ["It's DON'T 'S x''s a'.' dogs' café-au ÉTÉ... Å K. 9a. a_ `a``", "<|endoftext|> a <|startoftext|>",
             "end <|endoftext|> start", "a<|endoftext|>b", "<|ENDOFTEXT|> x<|startoftext|><|endoftext|>", "e<|endoftext|>\u0301 <|endoftext|",
             "İstanbul ΣΣΣ ß ẞ  x y z̈ ̈q", "", "\t\n\x0b\x0c\r  \x1c \x85 "]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x250), 32, 10, 0x301, 0x4e2d]))
                      for _ in range(60)) for _ in range(300)]
    words = WordTokens(PATH)
    for at in range(0, len(texts), 20):
        part = texts[at:at + 20]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert words.encode([t.encode() for t in part]) == want


def test_pieces_and_places(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (201, ""), (None, "four five"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = pack(docs, PATH, capacity=50).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc_id, k, s, len(ids[s:s + 50]), zlib.crc32(ids[s:s + 50].tobytes()))
                 for k, s in enumerate(range(0, len(ids), 50))]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=order) == sorted(want, key=order)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        ends = [0] + [o + n for o, n in sorted(items)]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 50
    assert len(bins) <= -(-sum(r.length for r in found) // 50) * 1.1 + 1


def test_files_of_pieces_follow_their_size(spark, monkeypatch):
    kept, cut_lineage = [], packing.cut_lineage
    monkeypatch.setattr(packing, "cut_lineage", lambda frame: kept.append(cut_lineage(frame)) or kept[-1])
    docs = spark.range(90).selectExpr("id AS doc_id", "repeat('one ', CAST(id % 7 AS INT)) AS text").repartition(30)
    found = pack(docs, PATH, capacity=50).collect()
    assert kept[0].rdd.getNumPartitions() <= 4  # spark.sql.shuffle.partitions
    assert sorted(r.doc_id for r in found) == list(range(90))
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in map(sorted, bins.values()):
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))]
