import random
import zlib

import numpy as np

from tests.llm.corpora import prose
from votescore.llm.classifier import fit, scored, train


def auc(y, score):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_trees_learn_what_a_line_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert auc(y[3000:], model.score(x[3000:])) > 0.99


def test_without_labels_scores_are_even():
    assert fit(np.empty((0, 3)), np.empty(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (fit(np.ones((4, 3)), np.ones(4)).score(np.ones((1, 3))) > 0.9).all()


def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        text = prose(rng, rng.randint(20, 120))
        if i % 4 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "*** "), (text[:20] + " ") * 12])
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0), 0))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taught = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in scored(docs, train(docs, taught)).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    held = [d for d in found if found[d].held_out]
    assert auc(np.array([labels[d][1] for d in held]), np.array([found[d].score for d in held])) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spoiled = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, spoiled))
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()
