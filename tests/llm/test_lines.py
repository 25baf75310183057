import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.corpora import WORD, edited_lines
from votescore.llm import line_dedup
from votescore.llm.line_dedup import MIN_CHARS, remove_repeated_lines, repeated_lines, variant_hashes


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < MIN_CHARS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def model(rows):
    """Every line against all earlier ones."""
    gone, before = set(), []
    for d, i, line in sorted((d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if WORD.search(x)):
        if any(near(line, other) for other in before):
            gone.add((d, i))
        before.append(line)
    result = {}
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone)
        result[d] = (sum(1 for x in lines if WORD.search(x)), sum((d, i) in gone for i in range(len(lines))),
                     None if t is None else kept)
    return result


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_comparing_all_lines(spark, seed):
    rows = edited_lines(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = model(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in repeated_lines(docs).collect()}
    assert got == {d: (a, b, hashlib.sha256((t or "").encode()).hexdigest()) for d, (a, b, t) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 20
    assert {r.doc_id: r.text for r in remove_repeated_lines(docs).collect()} == {d: t for d, (_, _, t) in want.items()}


def test_lines_with_equal_first_hash_are_not_equal(spark, monkeypatch):
    """Every line of a length has the same id; the second hash keeps them apart."""
    monkeypatch.setattr(line_dedup, "_id", lambda line: F.char_length(line).cast("long"))
    rows = edited_lines(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_lines(docs).collect()} == {d: t for d, (_, _, t) in model(rows).items()}


def test_long_line_leaves_in_parts(monkeypatch):
    monkeypatch.setattr(line_dedup, "EMITTED", 7)
    lines = ["abcdefghijklmnopqrst", "", "xyz" * 9]
    rows = pa.RecordBatch.from_pydict({"place": [{"line_no": i} for i in range(3)], "line": lines})
    parts = list(line_dedup._neighbourhood(iter([rows])))
    assert max(p.num_rows for p in parts) == 7
    got = [r for p in parts for r in p.to_pylist()]
    assert got == [{"variant": h, "gap": g - 1, "place": {"line_no": i}}
                   for i, x in enumerate(lines) for g, h in enumerate(variant_hashes(x).tolist())]


def test_variants_are_hashes_of_the_shorter_lines():
    line = "héllo wörld 😀 aab"
    hashes = variant_hashes(line)
    for i in range(len(line)):
        assert variant_hashes(line[:i] + line[i + 1:])[0] == hashes[1 + i]
    assert len(np.unique(variant_hashes("abcdefghij" * 50))) == 501


def test_many_lines_around_one(spark):
    """All one edit from the first: one group of a variant, every line but the first goes."""
    center = "the line that everyone has copied with an edit"
    lines = [center] + [center[:i] + c + center[i + 1:] for i in range(len(center)) for c in "#%&"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sorted(r.doc_id for r in repeated_lines(docs).where("n_removed = 0").collect()) == [0]


def test_shorter_lines_as_near_lines(spark):
    """The smallest length that is compared by edits is the caller's."""
    docs = spark.createDataFrame([(1, "short line"), (2, "short lines"), (3, "abc"), (4, "abd"), (5, "x")], "doc_id long, text string")
    kept = lambda *least: sorted(r.doc_id for r in remove_repeated_lines(docs, *least).collect() if r.text)
    assert kept() == [1, 2, 3, 4, 5] and kept(10) == [1, 3, 4, 5] and kept(1) == [1, 3, 5]
