import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.corpora import prose
from votescore.llm.fingerprints import compared, edits, fingerprint


def sentences(rng, n):
    return "".join(prose(rng, rng.randint(4, 12)).capitalize() + rng.choice([". ", ".\n"]) for _ in range(n))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(1)
    rows = [(3 * i, sentences(rng, rng.randint(10, 60))) for i in range(120)]
    rows += [(1, rows[0][1]), (1000, ""), (1001, None), (1003, "é"), (1006, "日本 語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in compared(docs).collect()}
    ordered = sorted((d, t or "") for d, t in rows)
    for i, (doc_id, text) in enumerate(ordered):
        cut, after = len(text) // 4, ordered[(i + 1) % len(ordered)][1]
        edited = text[:len(text) - cut] + after[:cut]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert r.near_next == 1 if text == after else r.near_next < 0.3
        if doc_id < 1000 and text != after:
            assert 0.3 < r.near_edited < 1 and r.near_edited > r.near_next
    prints = {}
    for doc_id, text in ordered:
        prints.setdefault(text, set()).add(found[doc_id].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len(set.union(*prints.values())) == len(prints)


def test_ids_that_are_missing_or_shared(spark):
    rows = [(None, f"x{i}. y. z") for i in range(20)] + [(7, "a"), (7, "b"), (7, "a"), (9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_chars) for r in compared(docs).collect()) == sorted((str(d), len(t)) for d, t in rows)


def test_equal_texts_only(spark):
    texts = ["a\nb", "a\n\nb", "a b", "ab", "a\nb\n", "", " "]
    frame = spark.createDataFrame([(t,) for t in texts * 2], "t string").select(fingerprint(F.col("t")).alias("f"))
    assert frame.distinct().count() == len(texts)


def test_edits_are_located(spark):
    rng = random.Random(8)
    old = [f"Paragraph {i} {prose(rng, 6)}.\n" for i in range(200)]
    new = old[:50] + ["Inserted.\n"] + old[50:120] + ["Changed.\n"] + old[121:]
    r = edits(spark.createDataFrame([("".join(old), "".join(new))], "a string, b string"), "a", "b").first()
    assert not r.equal and r.paragraphs_lost == [120] and r.paragraphs_new == [50, 121]
    assert 1 <= r.sections_lost <= 4 and 1 <= r.sections_new <= 4
    same = edits(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first()
    assert same.equal and same.sections_lost == 0 and same.paragraphs_new == []
