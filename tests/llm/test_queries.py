"""The named queries and the pipeline on the smallest tables, against SQL or brute force."""

import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm import test_lines, test_passages, test_runs, test_simhash
from tests.llm.corpora import WORD
from votescore.llm import bpe
from votescore.llm.oracles import QUALITY_STATS
from votescore.llm.queries import ORACLES, QUERIES
from votescore.llm.simhash import smallest_reachable


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{sf_dir}/{name}'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted(map(str, map(tuple, frame.select(*columns).collect()))) == sorted(map(str, want))


def test_op1(spark, sf_dir, texts):
    want = test_lines.model(list(texts.items()))
    found = QUERIES["op1_line_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in found} == {
        d: (a, b, hashlib.sha256(t.encode()).hexdigest()) for d, (a, b, t) in want.items()}


def test_op4(spark, sf_dir, texts):
    found = QUERIES["op4_substring_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == test_passages.model(list(texts.items()))


def test_op5(spark, sf_dir, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op5_byte_bpe"](spark, sf_dir).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def components(texts):
    ids = sorted(texts)
    prints = np.array([test_simhash.model_fingerprint(texts[d]) for d in ids], np.uint64)
    pairs = sorted(test_simhash.all_pairs(prints)) or [(0, 0)]
    label = smallest_reachable(len(ids), *map(np.array, zip(*pairs)))
    return {d: (int(p), ids[c]) for d, p, c in zip(ids, prints, label)}


def test_op7(spark, sf_dir, texts):
    want = components(texts)
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect()}
    assert found == want
    assert len({c for _, c in want.values()}) < len(want)


def test_op13(spark, sf_dir, texts):
    assert test_runs.rows(QUERIES["op13_periodic_runs"](spark, sf_dir)) == sorted((test_runs.model(*d) for d in texts.items()), key=str)


def near_copies_are_dropped(given, kept):
    """By the similarity of all pairs of sets of 5-word shingles."""
    shingles = {}
    for d, t in given.items():
        w = WORD.findall(t.lower())
        shingles[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    ids = sorted(given)
    near = {(a, b): s for i, b in enumerate(ids) for a in ids[:i] if (s := alike(a, b)) >= 0.5}
    assert not [pair for pair, s in near.items() if s >= 0.9 and kept.issuperset(pair)]
    assert {d for d in ids if not any(d in pair for pair in near)} <= kept
    assert len(kept) < len(ids)


def test_stages_on_their_own_input(spark, sf_dir, duck, tmp_path):
    """Each stage against brute force over what its predecessor kept."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert spark.read.parquet(f"{tmp_path}/{name}").columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    text = {name: {r.doc_id: r.text for r in rows} for name, rows in kept.items() if name != "best_fit_packing"}

    sql = "WITH " + QUALITY_STATS.replace("{documents}", "documents") + " SELECT doc_id FROM judged WHERE kept"
    assert sorted(text["quality_rules"]) == sorted(r[0] for r in duck.execute(sql).fetchall())
    assert text["line_dedup"] == {d: t for d, (_, _, t) in test_lines.model(list(text["quality_rules"].items())).items()}
    near_copies_are_dropped(text["line_dedup"], set(text["simhash_near_dedup"]))
    want = test_passages.model(list(text["simhash_near_dedup"].items()))
    left = [(d, hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest()) for d, t in text["substring_dedup"].items()]
    assert sorted(left) == [(r[0], r[3]) for r in want]
    assert {r.doc_id for r in kept["best_fit_packing"]} == set(text["substring_dedup"])
    tokens = sum(r.length for r in kept["best_fit_packing"])
    assert len({r.sequence_id for r in kept["best_fit_packing"]}) <= -(-tokens // 4096) * 1.05 + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length").collect())) == sorted(
        (r.doc_id, r.piece, r.length) for r in kept["best_fit_packing"])
