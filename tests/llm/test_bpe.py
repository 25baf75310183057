import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from votescore.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_every_character(ours, theirs):
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}b {chr(code)}"
            assert ours.encode(text) == theirs.encode_ordinary(text), hex(code)


def test_random_texts(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 500)
    rng = random.Random(0)
    tokens = list(bpe.read_ranks(PATH))
    for i in range(6000):
        kind = i % 3
        if kind == 0:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode("utf8", "replace")
        elif kind == 1:
            text = "".join(rng.choice("aab tthe\n  s'") for _ in range(rng.randint(0, 60)))
        else:
            text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x9FFF)]))
                           for _ in range(rng.randint(0, 30)))
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "ab" * 50_000, "=" * 100_001, "é" * 50_000])
def test_long_matches_in_linear_time(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_tokens_that_merging_never_makes():
    """'abc' can't be merged: 'bc' goes first and 'a' + 'bc' is no token. As a whole match it is itself all the same."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"cd": 259}
    del ranks[b"abc"]
    ranks[b"abcd"] = 258
    merges = bpe.Merges(ranks)
    want = tiktoken.Encoding("t", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for text in ["abcd", "abcdabcd", "aab", "abab", "bcd"] + ["".join(rng.choice("abcd") for _ in range(12)) for _ in range(500)]:
        assert list(merges.encode(text.encode())) == want.encode_ordinary(text)


def test_round_trip(spark, theirs):
    rows = [(1, "It's a test.\n\n  ok"), (2, None), (3, ""), (None, "é 日本"), (1, "It's a test.\n\n  ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    again = bpe.decoded(bpe.encoded(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes).decode() for r in again.collect()) == sorted(t or "" for _, t in rows)
