"""Counts against plain Python; thresholds and verdicts are compared with SQL in test_queries."""

import random
from collections import Counter

from tests.llm.corpora import WORD, prose
from votescore.llm.quality_rules import quality_filter, quality_verdicts


def model(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def corpus():
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "a#b |c| <d>\n\nx\nx\n x\nx",
             "é\x0bü\x0cß", "   ", "p q r s t u v w x " * 3, "w" * 5000 + " " + prose(rng, 30)]
    texts += [prose(rng, rng.randint(20, 200)) for _ in range(300)]
    texts += [prose(rng, 60).replace(" ", "## ") for _ in range(10)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts)]


def test_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert len(found) == len(rows)
    for doc_id, text, _, _ in rows:
        r, want = found[doc_id], model(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    clean, junk = range(12, 312), range(312, 322)
    assert sum(found[i].kept for i in clean) >= 297
    assert not any(found[i].kept for i in junk)


def test_filter_keeps_columns_and_agrees(spark):
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(corpus())],
                                 "doc_id long, text string, lang string, source string, q int, row string")
    kept = quality_filter(docs)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality_verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
