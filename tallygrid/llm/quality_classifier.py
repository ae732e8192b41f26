"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a labelled sample of fixed maximal size are collected and the
trees are grown on quantile bins: per level, one histogram of gradients over
(node, feature, bin) decides all splits. The trees are then complete binary trees
laid out in arrays, and every batch of documents descends all of them at once with
numpy indexing.

Defined results: a null or wordless text has all-zero statistics and is scored
like any other; without labels of both classes every score is the prior (0.5 with
no label at all); repeated rows score equally; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import id_fold, map_batches, texts
from tallygrid.llm.textstats import FEATURES, features

#: Labelled rows the trees are grown on, at most; taken in the order of a hash of the id.
SAMPLE_ROWS = 20_000
#: Rows judged at once, whose texts and statistics are in a worker's memory together.
SLICE = 1000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 4.0


class Trees(NamedTuple):
    """Complete trees of equal depth: inner nodes in breadth-first order, then leaves."""

    feature: np.ndarray  # [tree, 2**depth - 1]
    threshold: np.ndarray
    leaf: np.ndarray  # [tree, 2**depth]
    base: float


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` and the statistics of every whole text as one array."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [features(t) for t in texts(batch)]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(rows, pa.list_(pa.float64()))], [*carry, "stats"])
        return work
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in carry) + "stats array<double>"
    return map_batches(docs.select(*carry, F.col("text").cast("string").alias("text")), schema, make)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (id_fold("doc_id", 3) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # Bounded by ``most`` rows of two numbers. An id that many rows have counts once, with the smallest of its texts.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    table = statistics(picked, "doc_id", "y").toArrow()
    order = np.lexsort((table["y"].to_numpy(), table["doc_id"].to_numpy()))
    x = np.array(table["stats"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x[order], table["y"].to_numpy()[order].astype(np.float64)


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost ``TREES`` trees under logistic loss."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    if len(set(y.tolist())) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cell = bins + np.arange(width) * BINS
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), base)
    margin = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            count = 2 ** depth
            at = (cell + (node * width * BINS)[:, None]).ravel()
            shape = (count, width, BINS)
            g = np.bincount(at, np.repeat(grad, width), minlength=count * width * BINS).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(hess, width), minlength=count * width * BINS).reshape(shape).cumsum(2)
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g ** 2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g ** 2 / (total_h + RIDGE)
            gain[(h < LEAST_WEIGHT) | (total_h - h < LEAST_WEIGHT)] = -1
            best = gain.reshape(count, -1).argmax(1)
            feature, split = best // BINS, best % BINS
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            first = count - 1
            for k in range(count):
                if good[k] and split[k] < len(edges[feature[k]]):
                    out.feature[t, first + k], out.threshold[t, first + k] = feature[k], edges[feature[k]][split[k]]
            at_node = first + node
            node = 2 * node + (x[np.arange(n), out.feature[t, at_node]] > out.threshold[t, at_node])
        g, h = np.bincount(node, grad, minlength=leaves), np.bincount(node, hess, minlength=leaves)
        out.leaf[t] = RATE * g / (h + RIDGE)
        margin += out.leaf[t][node]
    return out


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Scores of all rows; every level is one gather over (row, tree)."""
    count = len(trees.leaf)
    tree = np.arange(count)
    node = np.zeros((len(x), count), np.int64)
    for _ in range(DEPTH if count else 0):
        value = np.take_along_axis(x, trees.feature[tree, node], axis=1)
        node = 2 * node + 1 + (value > trees.threshold[tree, node])
    margin = trees.base + trees.leaf[tree, node - (2 ** DEPTH - 1)].sum(axis=1) if count else np.full(len(x), trees.base)
    return 1 / (1 + np.exp(-margin))


def score_texts(trees: Trees, batch_texts: list[str]) -> np.ndarray:
    return predict(trees, np.array([features(t) for t in batch_texts], dtype=np.float64).reshape(-1, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    return grow(*sample(docs, labels))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    trees = train(docs, labels)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = score_texts(trees, texts(batch))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        return work
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(source, "doc_id long, held_out boolean, score double, predicted int", make)


def reject_poor(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``least``."""
    trees = train(docs, labels)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array(score_texts(trees, texts(part)) >= least))
    return docs.mapInArrow(run, docs.schema)
