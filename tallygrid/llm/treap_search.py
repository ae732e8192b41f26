"""Ranked lexical search over K2-treaps of documents and query terms.

Documents are read once for a block of items: what is kept of a document is its length and
the counts of the block's terms. A task lays its documents out in ranges of bounded size. For
each range the grid of terms and documents is a compressed quadtree: a cell of the tree stands
for a square of the grid, holds the largest impact below it together with its place, and its
four parts hold what is left of the square; empty parts take one bit. Terms are laid out by
falling weight, so that neighbouring rows have impacts of like size.

An item descends with all its rows at once: a state is a range of documents with the cells on
the paths of the item's rows. Impacts met on the way belong to their documents; the state's
bound is the largest sum met so far in its range plus what its cells still hold at most. The
states with the best bounds go first, in waves, and a state that cannot reach the item's tenth
score is left with all its documents; scores are whole numbers, so bounds are exact. The tenth
score is carried over from range to range of a task. The tasks' best ten are merged.

Items are dealt to blocks of bounded size (``BLOCK_TERMS`` distinct terms per item, summed),
and each block is one pass over the documents, so what travels to the tasks never grows with
the tables. Documents are cut by rows into tasks, whatever their terms: a term or a text that
very many documents share makes no task larger.

Defined results: a null text has no term; documents without terms have no score and items
without terms no result; rows that share a document's or an item's id are documents or items
of their own; a null document id comes after all others among equal scores; texts of any
length are read whole; empty tables give an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, stored

#: Documents reported for an item.
BEST = 10
#: Terms of the items in one block, about; documents and grid points of one range.
BLOCK_TERMS, RANGE_DOCUMENTS, RANGE_POINTS = 200_000, 8192, 4_000_000
#: States that go down together in the first wave; each further wave takes twice as many.
WAVE = 128
#: Parts that an item's results are merged in before the last merge.
PARTS = 256
#: A-Z lower-cased, ASCII that is no letter or digit blank; bytes of other characters stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def spread(x: np.ndarray) -> np.ndarray:
    """A zero bit before every bit of numbers below 2^32."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Points (row, column, impact) of a square grid. ``levels[k]`` are the cells of side 2^k: their
    impact, row and column, and the number of their first part among those of the next level;
    behind the last cell of a level stands an empty one."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, rows: int, columns: int):
        self.depth = max(1, rows - 1, columns - 1).bit_length()
        code = (spread(row) << np.uint64(1)) | spread(column)
        order = np.argsort(code)
        code, row, column, impact = code[order], row[order], column[order], impact[order]
        self.levels, above = [], None
        for k in range(self.depth, -1, -1):
            key = code >> np.uint64(2 * k)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            cells = key[first]
            if above is not None:
                # One bit for each part of the cells above; the number of a part is the count of bits before it.
                bits = np.zeros(4 * len(above) + 5, np.uint8)
                bits[4 * np.searchsorted(above, cells >> np.uint64(2)) + (cells & np.uint64(3)).astype(np.int64)] = 1
                rank = np.cumsum(bits, dtype=np.int32) - bits
                self.levels[-1] += (np.where(bits, rank, len(cells)).astype(np.int32),)
            size = np.diff(np.r_[first, len(key)])
            most = np.maximum.reduceat(impact, first) if len(first) else impact[:0]
            top = np.flatnonzero(impact == np.repeat(most, size))
            top = top[np.r_[True, np.diff(np.repeat(np.arange(len(first)), size)[top]) != 0]] if len(top) else top
            self.levels.append((np.r_[impact[top], 0], np.r_[row[top], -1], np.r_[column[top], 0]))
            rest = np.ones(len(key), bool)
            rest[top] = False
            above, code, row, column, impact = cells, code[rest], row[rest], column[rest], impact[rest]
        self.levels.reverse()


class Top:
    """The best documents of one item so far."""

    def __init__(self, best: int):
        self.best = best
        self.score, self.none, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        score, none, doc = np.r_[self.score, score], np.r_[self.none, none], np.r_[self.doc, doc]
        order = np.lexsort((doc, none, -score))[:self.best]
        self.score, self.none, self.doc = score[order], none[order], doc[order]

    def reachable(self, bound: np.ndarray, none: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a range with this bound and first document may hold one of the best."""
        if len(self.score) < self.best:
            return bound > 0
        least = self.score[-1]
        early = (none < self.none[-1]) | ((none == self.none[-1]) & (doc < self.doc[-1]))
        return (bound > least) | ((bound == least) & early)


def search(treap: Treap, rows: np.ndarray, none: np.ndarray, docs: np.ndarray, top: Top, wave: int = WAVE) -> int:
    """Add the range's best documents for the item with these rows to ``top``; returns the number of
    states visited. Columns stand in the order of ``docs``."""
    found = np.zeros(1 << treap.depth, np.int64)  # what has been met of each document's score
    waiting: list[list[tuple]] = [[] for _ in range(treap.depth + 1)]
    root = np.full((1, len(rows)), 0 if len(treap.levels[treap.depth][0]) > 1 else -1)
    if root[0, 0] < 0:
        return 0
    waiting[treap.depth].append((np.zeros(1, np.int64), root, np.full(1, np.iinfo(np.int64).max)))
    visited = 0
    while any(waiting):
        for k in range(treap.depth, -1, -1):
            if not waiting[k]:
                continue
            column, cell, bound = (np.concatenate(x) for x in zip(*waiting[k]))
            waiting[k] = []
            first = np.minimum(column << k, len(docs) - 1)
            near = top.reachable(bound, none[first], docs[first])
            column, cell, bound = column[near], cell[near], bound[near]
            if len(column) > wave:
                order = np.argpartition(-bound, wave)
                now, later = order[:wave], order[wave:]
                waiting[k].append((column[later], cell[later], bound[later]))
                column, cell = column[now], cell[now]
            if not len(column):
                continue
            visited += len(column)
            impact, own, place = treap.levels[k][:3]
            met = np.flatnonzero((own[cell] == rows).reshape(-1))
            at = cell.reshape(-1)[met]
            np.add.at(found, place[at], impact[at])
            if k == 0:
                score = found[column]
                good = score > 0
                top.add(score[good], none[column[good]], docs[column[good]])
                continue
            parts = treap.levels[k][3]
            quarter = 4 * cell[:, None, :] + 2 * ((rows >> (k - 1)) & 1) + np.arange(2)[:, None]
            cell = parts[quarter.reshape(-1, len(rows))]
            column = (2 * column[:, None] + np.arange(2)).reshape(-1)
            bound = treap.levels[k - 1][0][cell].sum(axis=1) + found.reshape(-1, 1 << (k - 1))[column].max(axis=1)
            inside = (column << (k - 1)) < len(docs)
            waiting[k - 1].append((column[inside], cell[inside], bound[inside]))
        wave *= 2
    return visited


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): every item's distinct terms; items without terms are left out."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms = [sorted(set((t or b"").translate(TERMS).split())) for t in batch.column("raw").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])
        return work
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return map_batches(source, "item_id long, terms array<binary>", make).where(F.size("terms") > 0)


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): every document with a term, the number of all its terms and the counts of the numbered ones."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, terms, counts = [], [], []
            for raw in batch.column("raw").to_pylist():
                words = (raw or b"").translate(TERMS).split()
                sizes.append(len(words))
                known = np.array([k for k in map(number.get, words) if k is not None], np.int32)
                ids, times = np.unique(known, return_counts=True)
                terms.append(ids)
                counts.append(times.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return map_batches(source, "doc_id long, n long, terms array<int>, counts array<long>", make).where("n > 0")


def search_block(docs: DataFrame, items: list, best: int) -> DataFrame:
    """(item, item_id, doc_id, score): for each of a block's items (item_id, terms) the best of every task."""
    names = sorted({t for _, terms in items for t in terms})
    number = {t: k for k, t in enumerate(names)}
    grid = stored(postings(docs, number), "postings")
    sums = grid.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = sums["documents"], sums["terms"] or 0
    holding = np.zeros(len(names), np.int64)
    for row in grid.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        holding[row["t"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in holding.tolist()], np.int64)
    order = np.argsort(-weight, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    rows_of = [np.sort(place[[number[t] for t in terms if weight[number[t]] > 0]]) for _, terms in items]
    ids = [i for i, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(best) for _ in ids]
        held: list[pa.RecordBatch] = []

        def one_range() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            doc = table["doc_id"].combine_chunks()
            none, docs = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            sequence = np.lexsort((docs, none))
            at = np.empty(len(docs), np.int64)
            at[sequence] = np.arange(len(docs))
            lists, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks().flatten().to_numpy()
            term = lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
            length = np.array([10 + 90 * n * documents // all_terms for n in table["n"].to_pylist()], np.int64)
            impact = weight[term] * ((1_000_000_000 * counts) // (1000 * counts + 8 * length[of]))
            good = impact > 0
            treap = Treap(place[term[good]], at[of[good]], impact[good], len(weight), len(docs))
            for rows, top in zip(rows_of, tops):
                if len(rows):
                    search(treap, rows, none[sequence], docs[sequence], top)

        waiting = points = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                waiting += part.num_rows
                points += len(part.column("terms").flatten())
                if waiting >= RANGE_DOCUMENTS or points >= RANGE_POINTS:
                    one_range()
                    waiting = points = 0
        if held:
            one_range()
        sizes = [len(t.score) for t in tops]
        if sum(sizes):
            none = np.concatenate([t.none for t in tops])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(ids)), sizes)), pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                pa.array(np.concatenate([t.doc for t in tops]), pa.int64(), mask=none),
                pa.array(np.concatenate([t.score for t in tops]))], ["item", "item_id", "doc_id", "score"])

    return grid.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents of every item."""
    terms = stored(item_terms(items).withColumn("at", F.monotonically_increasing_id()), "item_terms")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_TERMS))
    found = []
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == block).select("item_id", "terms").collect()
        found.append(search_block(docs, [(r["item_id"], list(map(bytes, r["terms"]))) for r in mine], best)
                     .withColumn("block", F.lit(block)))
    rows = reduce(DataFrame.union, found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["block", "item", "part"], ["block", "item"]):
        if "part" in keys:
            rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return rows.select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS MATERIALIZED (SELECT rid, doc_id, COUNT(*) AS n FROM w GROUP BY ALL),
s AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS terms FROM n),
q AS MATERIALIZED (SELECT DISTINCT iid, item_id, term FROM (
  SELECT iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark))),
t AS MATERIALIZED (SELECT rid, doc_id, term, COUNT(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, docs),
i AS (SELECT t.rid, t.doc_id, t.term, f.weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n.n * s.docs) // s.terms)))) AS impact
      FROM t JOIN f USING (term) JOIN n USING (rid), s),
r AS (SELECT q.iid, q.item_id, i.rid, i.doc_id, CAST(SUM(i.impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING SUM(i.impact) > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
