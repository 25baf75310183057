import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_pipeline import simhash_near_dedup
from tests.llm.corpora import WORD, prose
from votescore.llm import simhash
from votescore.llm.simhash import close_pairs, components, drop_near_duplicates, fingerprint, links, near_duplicates, smallest_reachable


def model_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Two Words", "ÉCOLE Äh AB", "a b c d e f g a b c",
                                  prose(random.Random(1), 700), "x " * 300])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == model_fingerprint(text)


def test_long_text_in_bounded_memory():
    """Ten MB of words, over the borders of the parts it is read in."""
    text = (prose(random.Random(3), 900).encode() + b" \n\t") * 2000
    text = text[:10 << 20]
    tracemalloc.start()
    got = fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text), peak
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=max(1, n // 6), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        prints = prints ^ np.where(rng.random(n) < .6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(prints)


def all_pairs(prints):
    return {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 400])
def test_bit_planes_find_all_pairs(n):
    prints = clusters(n, n)
    found = {pair for u, v in close_pairs(prints, np.zeros(len(prints), int)) for pair in zip(u.tolist(), v.tolist())}
    assert found == all_pairs(prints)


@pytest.mark.parametrize("bucket", [2, 4096])
def test_components_of_all_links(spark, monkeypatch, bucket):
    """A bucket of two splits most tables again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = clusters(500, 9)
    pairs = all_pairs(prints)
    label = smallest_reachable(len(prints), *map(np.array, zip(*pairs)))
    signed = prints.view(np.int64).tolist()
    want = {}
    for x, c in zip(signed, label):
        want.setdefault(c, set()).add(x)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in components(links(frame)).collect()}
    got = {}
    for x in signed:
        got.setdefault(root.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(60)]
    edges = spark.createDataFrame(chain + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


@pytest.mark.parametrize("radius, width", [(0, 1), (1, 1), (7, 2), (46, 4)])
def test_bit_planes_of_any_radius_and_width(radius, width):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=(20, width), dtype=np.uint64)[rng.integers(0, 20, 300)]
    flips = rng.random((300, 64 * width)) < rng.random((300, 1)) * radius / (32 * width + 1)
    prints = base ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")
    found = {p for u, v in close_pairs(prints, np.zeros(300, int), radius) for p in zip(u.tolist(), v.tolist())}
    want = {(i, j) for j in range(300) for i in range(j)
            if sum((int(a) ^ int(b)).bit_count() for a, b in zip(prints[i], prints[j])) <= radius}
    assert found == want and want


@pytest.mark.parametrize("bucket", [3, 4096])
def test_similar_documents(spark, monkeypatch, bucket):
    """Copies with about one word in a hundred replaced (similarity about 0.9), and one large group of them."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(6)

    def edited(text, share):
        return " ".join("new" + str(rng.random()) if rng.random() < share else w for w in text.split())

    texts = [prose(rng, 400, 2000) for _ in range(30)]
    rows = [(100 * i + k, edited(t, 0.01 if k else 0)) for i, t in enumerate(texts) for k in range(3 if i else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in drop_near_duplicates(docs).collect())
    assert set(kept) >= {100 * i for i in range(30)} and len(kept) <= 31


def classes_of(spark, sets):
    rows = [(i, *np.array(simhash.wide_print(x), np.uint64).view(np.int64).tolist(),
             simhash.prefix(x, np.zeros(1 << simhash.BIN_BITS, np.int64)).view(np.int64).tolist()) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} long" for c in simhash.WORDS) + ", prefix array<long>")


def test_recall_does_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    """Pairs of sets of 400 shingles with a Jaccard similarity of 0.8 or 0.85."""
    rng, sets = np.random.default_rng(8), []
    for shared in (356, 368):
        for _ in range(60):
            own = rng.integers(0, 2**64, 800 - shared, dtype=np.uint64)
            sets += [np.unique(own[:400]), np.unique(own[400 - shared:])]
    found = []
    for bucket in (4096, 1):  # the second makes every bucket a large one
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found.append({(r.a, r.b) for r in simhash.candidates(classes_of(spark, sets))[0].collect()})
    assert found[0] == found[1] == {(i, i + 1) for i in range(0, 240, 2)}


def test_no_task_holds_a_large_bucket(spark):
    """Each two rows of a bucket meet in a tile, and tiles are bounded, also in the first table and by weight."""
    rows = [(t, 7, node, w) for t, n in ((0, 900), (1, 30)) for node, w in ((i, 1 + i % 3) for i in range(n))]
    frame = spark.createDataFrame(rows, "t long, part long, node long, w long")
    for weight, most in ((F.lit(1), 100), (F.col("w"), 200)):
        tiles = {}
        for r in simhash._tiles(frame, weight, most).collect():
            tiles.setdefault((r.t, r.part), set()).add(r.node)
        assert max(map(len, tiles.values())) < 150
        met = {(t, a, b) for (t, _), nodes in tiles.items() for a in nodes for b in nodes if a < b}
        assert len(met) == 900 * 899 // 2 + 30 * 29 // 2


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_model(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = smallest_reachable(len(rows), *map(np.array, zip(*pairs)))
    return sorted(rows[i][0] for i in set(label.tolist()))


def test_links_from_a_similarity_of_eight_tenths_on(spark):
    """Pairs just above and below 0.8, and chains of documents that are 0.75 similar to their neighbours."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.random()}" for _ in range(n)]
    rows = []
    for changed in [36, 40, 42, 44, 45, 46, 48, 50] * 6:  # 44 of 396 shingles: 352 / 440 = 0.8
        words = fresh(400)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-changed] + fresh(changed)))]
    words = fresh(400)
    for _ in range(12):
        rows.append((len(rows), " ".join(words)))
        words = words[52:] + fresh(52)
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == kept_by_model(rows) == sorted(set(range(108)) - {2 * i + 1 for i in range(48) if i % 8 < 4})


@pytest.mark.parametrize("own, groups", [(12, 1), (45, 150)])
def test_dense_groups(spark, own, groups):
    """150 documents around one template, pairwise about 0.92 or 0.78 similar: dense buckets either way."""
    rng = random.Random(own)
    template = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(template[:400 - own] + [f"{i}-{rng.random()}" for _ in range(own)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    dense = simhash.candidates(classes_of(spark, sets))[1]
    assert not dense.isEmpty()
    kept = sorted(r.doc_id for r in drop_near_duplicates(docs).collect())
    assert kept == kept_by_model(rows) if groups == 1 else kept == list(range(150))


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(3)
    texts = [prose(rng, 300) for _ in range(6)]
    rows = [(10 * i + k, t if k < 2 else t + " more") for i, t in enumerate(texts) for k in range(3)]
    rows += [(0, texts[0]), (900, None), (901, " "), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert groups[1] == 0 and groups[11] == 10 and groups[901] == groups[902] == groups[900] == 900
    assert all(groups[10 * i + 2] == 10 * i for i in range(6))
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [0, 10, 20, 30, 40, 50, 900]


def test_the_stage_finds_close_copies_by_their_fingerprints(spark, monkeypatch):
    """Without any other candidates: copies with another last word, of which those within the radius go."""
    real = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda prints: tuple(x.where("false") for x in real(prints)))
    rng = random.Random(21)
    rows = []
    for _ in range(40):
        words = prose(rng, 300, 2000).split()
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-2] + ["some", "more"]))]
    prints = [simhash.wide_print(np.unique(simhash.shingle_hashes(t.encode(), 5)))[0] for _, t in rows]
    close = {i + 1 for i in range(0, 80, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= simhash.RADIUS}
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(set(range(80)) - close) and len(close) > 10


def test_rows_of_connected_dense_buckets_move_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    buckets = {1: [1, 2, 3], 2: [2, 3, 4], 3: [1, 3], 4: [10, 11], 5: [20, 21, 22], 6: [22, 23, 24]}
    rows = [(0, part, node, *[node] * simhash.WIDE, 5) for part, nodes in buckets.items() for node in nodes]
    schema = "t long, part long, node long, " + ", ".join(f"{c} long" for c in simhash.WORDS) + ", n long"
    found = {}
    for r in simhash._gathered(spark.createDataFrame(rows, schema)).collect():
        found.setdefault((r.t, r.part), []).append(r.node)
    # The first three become one bucket; the last two would be over BUCKET rows and stay as they are.
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4], [10, 11], [20, 21, 22], [22, 23, 24]]


def test_kept_rows_are_dealt_out_once(spark, monkeypatch):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "h i j k l m", "z"), (None, "h i j k l m", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = drop_near_duplicates(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(tuple(r) for r in kept.where("doc_id is not null").collect()) == [rows[0]]
    assert [tuple(r) for r in kept.where("doc_id is null").collect()] == [rows[3]]
    assert plan.count("Exchange hashpartitioning") == 2  # the documents and the chosen keys


def test_the_stage_keeps_one_row_of_all_that_the_operator_links(spark):
    """Also of texts whose repeated words give them close fingerprints, while their sets of five words differ; and of similar
    sets, whose fingerprints differ."""
    rng, texts = random.Random(33), [None, "", "one", "two words"]
    for _ in range(12):
        words, many = prose(rng, 60, 400).split(), prose(rng, 60, 400).split()
        chorus = " ".join(many[:13]) + " "
        texts += [chorus * 30 + " ".join(words[:10]), chorus * 30 + " ".join(words[10:20]), chorus * 20 + " ".join(words[20:34])]
        long = prose(rng, 300, 1500).split()
        texts += [" ".join(long), " ".join(long[:100] + ["new"] + long[100:160] + ["other"] + long[160:])]
    n = len(texts)
    prints = [model_fingerprint(t) for t in texts]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    close = {(i, j) for j in range(n) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}
    similar = {(i, j) for j in range(n) for i in range(j) if sets[i] | sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(close - similar) > 10 and len(similar - close) > 5
    u, v = np.array(sorted(close | similar)).T
    want = sorted(set(smallest_reachable(n, u, v).tolist()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_near_dedup(spark, docs, "").collect()) == want
