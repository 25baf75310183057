"""Queries 3, 8, 9 and 10 over the smallest tables, against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from votescore.llm import classifier
from votescore.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def test_op3(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc_id, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    found = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for items in held.values():
        ends = [0]
        for offset, length in sorted(items):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    # No more sequences than best-fit decreasing takes.
    gaps = []
    for length in sorted((w[3] for w in want), reverse=True):
        best = min((i for i, g in enumerate(gaps) if g >= length), key=gaps.__getitem__, default=None)
        if best is None:
            gaps.append(4096 - length)
        else:
            gaps[best] -= length
    assert len(held) <= len(gaps)


def test_op8(spark, sf_dir, texts):
    found = QUERIES["op8_sharding"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items())
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(map(len, slots.values()))
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r.shard for r in found[:64]) != [r.shard for r in found[:64]]
    again = QUERIES["op8_sharding"](spark, sf_dir).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in found} == {(r.doc_id, r.shard, r.slot) for r in again}


def paragraphs(text):
    """Cut behind a line end, behind . ! or ? and a blank, and 96 characters behind the last cut."""
    out, begin = [], 0
    for end in range(1, len(text) + 1):
        grown = end - begin == 96 and not set(text[begin:end]) & set("\n\r\x85  ")
        if text[end - 1] == "\n" or text[end - 1] == " " and text[end - 2:end - 1] in (".", "!", "?") or grown:
            out.append(text[begin:end])
            begin = end
    return [*out, text[begin:]]


def merkle(text):
    """(root, short hashes of the paragraphs)."""
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in paragraphs(text)]
    sections, open_ = [], []
    for i, h in enumerate(hashes):
        open_.append(f"{h:X}")
        if h % 8 == 0 or i == len(hashes) - 1:
            sections.append(sha(open_))
            open_ = []
    return sha(sections)[:32], [h >> 32 for h in hashes]


def alike(a, b):
    if a[0] == b[0]:
        return 1.0
    mine, other = set(a[1]), set(b[1])
    return len(mine & other) / max(len(mine), len(other))


def test_op9(spark, sf_dir, texts):
    ids = sorted(texts)
    trees = {d: merkle(texts[d] or "") for d in ids}
    shown = lambda t: t[0] + ":" + "".join(f"{h:08x}" for h in t[1])
    want = []
    for d, after in zip(ids, ids[1:] + ids[:1]):
        text, following = texts[d] or "", texts[after] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        changed = merkle(edited)
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(trees[d]), shown(changed),
                     alike(trees[d], changed), alike(trees[d], trees[after])))
    found = QUERIES["op9_document_fingerprints"](spark, sf_dir).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").orderBy("doc_id")
    assert list(map(tuple, found.collect())) == want


def test_op10(spark, sf_dir, texts):
    """Scores by walking the trees one document and one node at a time. (How good they are is tested in test_classifier.)"""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels)

    def walk(x):
        total = model.base
        for feature, threshold, leaf in zip(model.feature.tolist(), model.threshold.tolist(), model.leaf.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    x = {r.doc_id: r.x for r in classifier.statistics(docs.select("doc_id", "text")).collect()}
    found = QUERIES["op10_quality_classifier"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert abs(r.score - walk(x[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_histogram_splits_are_the_best_ones():
    """The first split of the first tree, by trying every threshold of every feature."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 1.5, 300) > 4).astype(float)
    model = classifier.fit(x, y)
    p = y.mean()
    gradient, curvature = p - y, np.full(300, p * (1 - p))
    worth = lambda m: gradient[m].sum() ** 2 / (curvature[m].sum() + classifier.PENALTY)
    gains = {(f, t): worth(x[:, f] <= t) + worth(x[:, f] > t) for f in range(3) for t in range(8)
             if min(curvature[x[:, f] <= t].sum(), curvature[x[:, f] > t].sum()) >= classifier.LEAST_CURVATURE}
    assert max(gains, key=gains.get) == (model.feature[0, 0], model.threshold[0, 0])
