"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are column expressions over the whole text; language, source, id and labels are no inputs. The model is fit
on the driver on at most `TRAIN_ROWS` labelled rows (those with the smallest hash of their id, a sample that does not
depend on order; with repeated documents at most twice as many rows), of which only the statistics are collected. Values are put into at most `BINS` quantile bins; each
level of a tree is grown from histograms of gradients and curvatures. Trees are complete and flattened into arrays
(feature and threshold by node, value by leaf), which numpy walks for all rows of a batch at once, level by level.
Every row is scored in the tasks that read it.

NULL and empty texts have statistics of zero and a score like any other. Rows without a label, with a NULL label or
held out teach nothing; a doc_id with several labels brings each of them, and repeated rows count as often as they
stand. Without usable labels every score is 0.5. An empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore.llm.quality_rules import counted

TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
#: Of the curvature in a leaf.
PENALTY = 1.0
LEAST_CURVATURE = 2.0
KEEP = 0.7

PATTERNS = {"upper": r"\p{Lu}", "digits": r"[0-9]", "shouts": "!", "stops": r"[.?,;:]", "lines": "\n"}
STATISTICS = ["n_words", "word_length", "line_words", "symbols", "dup_lines", "repeats", "stutter", "upper", "digits",
              "shouts", "stops", "lines"]


def statistics(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame without the text, with an array `x` of STATISTICS."""
    q = lambda name: F.col(f"q.{name}").cast("double")
    per = lambda part, whole: part / F.greatest(whole, F.lit(1.0))
    body = F.coalesce(F.col(text), F.lit(""))
    marks = {name: F.regexp_count(body, F.lit(p)).cast("double") for name, p in PATTERNS.items()}
    x = [F.log1p(q("n_words")), per(q("word_chars"), q("n_words")), F.log1p(per(q("n_words"), q("n_lines"))),
         per(q("n_symbols"), q("word_chars")), per(q("n_dup_lines"), q("n_lines")), per(q("n_repeat_words"), q("n_words")),
         per(q("n_stutter"), q("n_words"))] + [per(value, q("word_chars")) for value in marks.values()]
    return counted(frame, text).withColumn("x", F.array(*x)).drop("q", text)


# --- model -----------------------------------------------------------------------------------------


@dataclass
class Model:
    base: float
    feature: np.ndarray  # (tree, node), nodes in heap order
    threshold: np.ndarray  # (tree, node): larger values go right
    leaf: np.ndarray  # (tree, leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic loss. A split must lower the loss; a node without one sends every row to its left child."""
    n, features = x.shape
    nodes = (1 << DEPTH) - 1
    if n == 0:
        return Model(0.0, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="inverted_cdf")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T)], 1)
    upper = np.stack([np.concatenate((e, np.full(BINS - len(e), np.inf))) for e in edges])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(n, base)
    model = Model(base, np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes + 1)))
    cell = binned + np.arange(features) * BINS
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (features * BINS) + cell).ravel()
            shape = (width, features, BINS)
            g = np.bincount(at, np.repeat(gradient, features), width * features * BINS).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(curvature, features), width * features * BINS).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            worth = lambda a, b: a * a / (b + PENALTY)
            gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
            gain[(h < LEAST_CURVATURE) | (all_h - h < LEAST_CURVATURE)] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = np.flatnonzero(gain.reshape(width, -1)[np.arange(width), best] > 1e-6)
            feature, bin_ = np.divmod(best[split], BINS)
            model.feature[tree, first + split] = feature
            model.threshold[tree, first + split] = upper[feature, bin_]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[tree, node]] > model.threshold[tree, node])
        leaf = node - nodes
        g, h = np.bincount(leaf, gradient, nodes + 1), np.bincount(leaf, curvature, nodes + 1)
        model.leaf[tree] = -RATE * g / (h + PENALTY)
        total += model.leaf[tree][leaf]
    return model


# --- Spark -----------------------------------------------------------------------------------------


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & F.col("doc_id").isNotNull()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that are not held out. Rows are sampled before their texts are read."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    taught = taught.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    sample = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found = statistics(rows.select("doc_id", "y", "text")).orderBy("doc_id", "y", "x").limit(2 * TRAIN_ROWS).collect()
    x = np.array([r.x for r in found], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in found], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", held_out().alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= KEEP, 1).otherwise(0))
