import hashlib

import pytest

from tests.llm.corpora import WORD, passages
from votescore.llm import substring_dedup
from votescore.llm.substring_dedup import WINDOW, remove_repeated_passages, repeated_passages


def model(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - WINDOW + 1):
            g = tuple(w[i:i + WINDOW])
            first[g] = min(first.get(g, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i:i + WINDOW])] < (d, i):
                gone |= set(range(i, i + WINDOW))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, group", [(0, 2000), (1, 2000), (0, 3), (2, 3)])
def test_equals_all_windows(spark, monkeypatch, seed, group):
    """With a group of 3 most prefixes are lengthened."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = model(rows)
    assert sorted(map(tuple, repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want
    assert sum(r[2] for r in want) > 500
    left = sorted((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest())
                  for r in remove_repeated_passages(docs).collect())
    assert left == [(r[0], r[3]) for r in want]


def test_text_keeps_its_blanks(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a\n\n{passage}  end\n"), (2, f"\tb\n{passage}\n\nrest of  it ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_passages(docs).collect()} == {
        1: f"a\n\n{passage}  end\n", 2: "\tb\nrest of  it "}
