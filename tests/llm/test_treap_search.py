"""The treap search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallygrid.llm import treap_search as ts

DOCS = "doc_id long, text string, n long, terms string, counts string, item long, part string"
ITEMS = "item_id long, text string, at string, terms string, raw string, block string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(words(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(2)
    vocabulary = ["the", "of", "é", "É", "x1", "日本"] + [f"W{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 10, 80])))) for k in range(700)]
    docs += [(800 + k, docs[5][1]) for k in range(40)]  # copies: more equal scores than places
    docs += [(None, docs[5][1]), (None, docs[9][1]), (3, docs[7][1]), (900, None), (901, ""), (902, "!? \x85"), (903, "rare " * 30_000)]
    items = [(k, docs[rnd.randrange(700)][1]) for k in range(30)]
    items += [(100, docs[5][1]), (101, None), (102, ""), (103, "nowhere"), (104, "rare the the THE"), (0, "W1 W2"), (None, "W3"),
              (105, " ".join(vocabulary) * 3)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "a", "b", 2, "c") for d in docs], DOCS).withColumn("a.b", F.lit(1)).repartition(3),
            spark.createDataFrame([(*i, "a", "b", "c", "d") for i in items], ITEMS).repartition(2))


@pytest.mark.parametrize("sizes", [(8192, 200_000, 128), (64, 150, 2)])
def test_search_equals_exhaustive(spark, monkeypatch, sizes):
    """In one range and block, and in many with narrow waves."""
    monkeypatch.setattr(ts, "RANGE_DOCUMENTS", sizes[0])
    monkeypatch.setattr(ts, "BLOCK_TERMS", sizes[1])
    monkeypatch.setattr(ts.search, "__defaults__", (sizes[2],))
    docs, items = corpus()
    if sizes[1] == 150:
        items = items[:4] + items[30:36]
    out = ts.ranked(*frames(spark, docs, items))
    assert sorted(map(tuple, out.collect()), key=repr) == plain(docs, items)


def test_treap_holds_every_point_once_under_larger_ones():
    rng = np.random.default_rng(3)
    cells = rng.choice(50 * 200, 3000, replace=False)
    row, column, impact = cells // 200, cells % 200, rng.integers(1, 40, 3000)
    treap = ts.Treap(row, column, impact, 50, 200)
    assert treap.depth == 8
    held = [p for level in treap.levels for p in zip(*(x[:-1].tolist() for x in (level[1], level[2], level[0])))]
    assert sorted(held) == sorted(zip(row.tolist(), column.tolist(), impact.tolist()))
    for k in range(treap.depth, 0, -1):
        impact, row, column, parts = treap.levels[k]
        below, own, place = treap.levels[k - 1][:3]
        seen = []
        for cell in range(len(impact) - 1):
            for quarter, part in enumerate(parts[4 * cell:4 * cell + 4].tolist()):
                if part < len(below) - 1:
                    seen.append(part)
                    assert below[part] <= impact[cell]
                    assert own[part] >> k == row[cell] >> k and place[part] >> k == column[cell] >> k
                    assert quarter == 2 * (own[part] >> k - 1 & 1) + (place[part] >> k - 1 & 1)
        assert sorted(seen) == list(range(len(below) - 1))


def test_search_leaves_most_documents_unvisited():
    """An item that is part of few documents visits a small part of the states."""
    rng = np.random.default_rng(5)
    docs, terms = 4096, 2048
    pairs = np.unique(rng.integers(0, docs * terms, 60_000))
    column, row = pairs // terms, pairs % terms
    planted = np.arange(0, terms, 100)
    more = np.array([d * terms + t for d in range(7, 4000, 333) for t in planted])
    pairs = np.unique(np.r_[pairs, more])
    column, row = pairs // terms, pairs % terms
    treap = ts.Treap(row, column, np.full(len(pairs), 1000) - row // 8, terms, docs)
    top = ts.Top(10)
    visited = ts.search(treap, planted, np.zeros(docs, bool), np.arange(docs), top)
    assert set(top.doc.tolist()) <= set(range(7, 4000, 333)) and visited < docs / 2


def test_empty_tables(spark):
    docs, items = corpus()
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items[:2])):
        out = ts.ranked(*frames(spark, d, i))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
