"""Module scores: a set's mean expression minus that of controls drawn from the same expression bins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.special import seeded_uniform, string_seed
from tallygrid.operators.matrix import Matrix
from tallygrid.plans.ordering import index_quantiles, numbered
from tallygrid.plans.session import cut_lineage

# Bins, controls per gene, and how often a small pool may be redrawn.
BINS, CONTROLS, REDRAW = 24, 100, 4
#: Weights of one block of sets, about; products and results formed at once in a task.
BLOCK_WEIGHTS, PRODUCTS, RESULTS = 2_000_000, 1_000_000, 200_000


def gene_averages(m: Matrix) -> DataFrame:
    """Mean of every gene over all cells, zeros included: gene, gene_id, avg."""
    n = m.cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = m.expr.groupBy("gene").agg(F.sum(F.col("value").cast("double")).alias("s"))
    return m.genes.join(sums, "gene", "left").select(
        "gene", "gene_id", (F.coalesce("s", F.lit(0.0)) / n).alias("avg"))


def expression_bins(averages: DataFrame, nbin: int = BINS) -> DataFrame:
    """Equal-count bins along (avg, gene_id): gene, gene_id, avg, pos, bin, at (place within the bin)."""
    placed = numbered(averages, [], "gene_id", "avg", "pos")
    n = averages.agg(F.count(F.lit(1)).alias("n")).scalar()
    bins = placed.withColumn("n", n).withColumn("nbin", F.greatest(F.lit(1), F.least(F.lit(nbin), F.col("n"))))
    bins = bins.withColumn(
        "bin", F.least(F.col("nbin") - 1, F.floor(F.col("pos") * F.col("nbin") / F.col("n"))).cast("int"))
    # First position of a bin: the smallest i with floor(i * nbin / n) >= bin.
    start = F.ceil(F.col("bin") * F.col("n") / F.col("nbin")).cast("long")
    return bins.withColumn("at", F.col("pos") - start).drop("n", "nbin")


def control_weights(sets: DataFrame, bins: DataFrame, ctrl: int = CONTROLS) -> DataFrame:
    """set_id, gene, weight for sets(set_id, gene, pos): members +1/size, controls minus their share.

    A control pool is its bin without the set's members, in bin order. The pool is
    never listed: the i-th non-member sits at bin place i plus the members before it.
    """
    bins = cut_lineage(bins.select("gene", "bin", "at"))
    mine = sets.join(bins, "gene").select("set_id", "gene", "pos", "bin", "at")
    # One array per (set, bin), bounded by the set's own size.
    taken = mine.groupBy("set_id", "bin").agg(F.array_sort(F.collect_list("at")).alias("taken"))
    bin_size = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("bin_size"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda s: s["gene"]), "|")
    seeds = mine.groupBy("set_id").agg(listed.alias("names"), F.count(F.lit(1)).alias("size"))
    seeds = seeds.select("set_id", "size", string_seed(F.col("names")).alias("seed"))
    members = (
        mine.join(taken, ["set_id", "bin"]).join(bin_size, "bin").join(seeds, "set_id")
        .withColumn("pool", F.col("bin_size") - F.size("taken"))
        .withColumn("draws", F.least(F.lit(ctrl), F.col("pool") * REDRAW).cast("long"))
    )
    order = Window.partitionBy("set_id").orderBy("pos")
    members = members.withColumn(
        "first_draw", F.sum("draws").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    draws = members.where("draws > 0").select(
        "set_id", "bin", "pool", "taken", "seed", F.coalesce("first_draw", F.lit(0)).alias("first_draw"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).alias("i"))
    draws = seeded_uniform(draws.withColumn("k", F.col("first_draw") + F.col("i")), "seed", "k", "u")
    draws = draws.withColumn("pick", F.floor(F.col("u") * F.col("pool"))).withColumn(
        "at", F.col("pick") + F.size(F.filter("taken", lambda x, j: x - j <= F.col("pick"))))
    controls = cut_lineage(draws.join(bins, ["bin", "at"]).groupBy("set_id", "gene").agg(F.count(F.lit(1)).alias("c")))
    totals = controls.groupBy("set_id").agg(F.sum("c").alias("total"))
    controls = controls.join(totals, "set_id").select("set_id", "gene", (-F.col("c") / F.col("total")).alias("weight"))
    # A set none of whose bins holds another gene is compared with every gene outside it, once each.
    size = seeds.select("set_id", "size")
    bare = size.join(totals, "set_id", "left_anti").agg(F.collect_list("set_id").alias("v")).scalar()
    positive = mine.join(size, "set_id").select("set_id", "gene", (1.0 / F.col("size")).alias("weight"))
    rest = (
        bins.select("gene", F.explode(bare).alias("set_id"))
        .join(mine, ["set_id", "gene"], "left_anti").join(size, "set_id")
        .withColumn("all", bins.agg(F.count(F.lit(1)).alias("n")).scalar()))
    return positive.unionByName(controls).unionByName(rest.select(
        "set_id", "gene", (F.lit(-1.0) / (F.col("all") - F.col("size"))).alias("weight")))


def score_many(m: Matrix, sets: DataFrame, nbin: int = BINS, ctrl: int = CONTROLS) -> DataFrame:
    """set_id, cell_id, score for several sets(set_id, gene, pos); every cell has a row.

    A blocked sparse product. The matrix is written once as a row per cell, and the weights are
    dealt into blocks of whole sets of about ``BLOCK_WEIGHTS`` entries. A block goes to the tasks as
    one compressed table by gene; a task adds up a cell's values times the block's weights in one
    array, so nothing but the scores leaves it. However many sets there are, non-zeros are shuffled
    once, and each block is a further scan.
    """
    cells = cut_lineage(m.cells.select("cell_id").join(
        m.expr.groupBy("cell_id").agg(F.collect_list(F.struct("gene", F.col("value").cast("double").alias("value"))).alias("row")),
        "cell_id", "left"))
    weights = cut_lineage(control_weights(sets, expression_bins(gene_averages(m), nbin), ctrl).select(
        "set_id", F.col("gene").cast("string").alias("gene"), "weight"))
    ids = cut_lineage(sets.select("set_id").distinct())
    return reduce(DataFrame.union, (block_scores(cells, block) for block in weight_blocks(ids, weights)))


def weight_blocks(ids: DataFrame, weights: DataFrame) -> Iterator[Block]:
    """The sets of ids(set_id) with their weights(set_id, gene as text, weight), in blocks of whole sets of about
    ``BLOCK_WEIGHTS`` entries. Both frames are read once per block; expensive ones should be written before."""
    blocks = max(1, math.ceil((weights.count() + ids.count()) / BLOCK_WEIGHTS))
    mine = F.pmod(F.xxhash64("set_id"), F.lit(blocks))
    for k in range(blocks):
        # About BLOCK_WEIGHTS rows; one set's weights are at most a row per gene.
        yield Block.of(ids.where(mine == k).toArrow()["set_id"], weights.where(mine == k).toArrow(), dict(ids.dtypes)["set_id"])


class Block(NamedTuple):
    """Weights of some sets, one gene after the other: the entries of gene k are starts[k]:starts[k + 1]."""

    sets: pa.Array
    kind: str
    genes: pa.Array
    starts: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sets: pa.ChunkedArray, weights: pa.Table, kind: str) -> Block:
        names = pa.array(sets.to_pylist(), sets.type)
        place = pc.index_in(weights["set_id"], value_set=names).to_numpy()
        coded = pa.array(weights["gene"].to_pylist(), pa.string()).dictionary_encode()
        gene = coded.indices.to_numpy()
        order = np.lexsort((place, gene))
        starts = np.r_[0, np.cumsum(np.bincount(gene, minlength=len(coded.dictionary)))]
        return cls(names, kind, coded.dictionary, starts, place[order], weights["weight"].to_numpy()[order])

    def scaled(self, keep: np.ndarray, factor: np.ndarray) -> Block:
        """The sets of a mask alone, each with its weights times its factor."""
        mine = keep[self.place]
        place = (np.cumsum(keep) - 1)[self.place[mine]]
        return self._replace(sets=self.sets.filter(pa.array(keep)), starts=np.r_[0, np.cumsum(mine)][self.starts],
                             place=place, weight=self.weight[mine] * factor[place])

    def scores(self, cell: np.ndarray, gene: pa.Array, value: np.ndarray, cells: int) -> np.ndarray:
        """[cell, set] for entries (cell, gene, value)."""
        coded = gene.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.genes).fill_null(-1).to_numpy(zero_copy_only=False)
        at = known[coded.indices.to_numpy()]
        cell, value, at = cell[at >= 0], value[at >= 0], at[at >= 0]
        out = np.zeros(cells * len(self.sets))
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        first = 0
        while first < len(at):  # pieces of about PRODUCTS products
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PRODUCTS, "right")))
            n = size[first:last]
            entry = np.arange(n.sum()) + np.repeat(self.starts[at[first:last]] - (np.cumsum(n) - n), n)
            out += np.bincount(np.repeat(cell[first:last] * len(self.sets), n) + self.place[entry],
                               np.repeat(value[first:last], n) * self.weight[entry], minlength=len(out))
            first = last
        return out.reshape(cells, len(self.sets))


def _products(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of cells(cell_id, row) with the block's scores [cell, set], about ``RESULTS`` at once."""
    step = max(1, RESULTS // max(1, len(block.sets)))
    for batch in batches:
        for start in range(0, batch.num_rows if len(block.sets) else 0, step):
            part = batch.slice(start, step)
            rows = part.column("row")
            size = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
            values = rows.flatten()
            yield part, block.scores(np.repeat(np.arange(len(rows)), size), values.field("gene").cast(pa.string()),
                                     values.field("value").to_numpy(zero_copy_only=False), len(rows))


def block_scores(cells: DataFrame, block: Block, shift: np.ndarray | float = 0.0) -> DataFrame:
    """set_id, cell_id, score of a block's sets for every cell(cell_id, row), plus each set's ``shift``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _products(batches, block):
            sets, rows = np.arange(len(block.sets)), np.arange(part.num_rows)
            yield pa.RecordBatch.from_arrays([
                block.sets.take(pa.array(np.tile(sets, len(rows)))), part.column("cell_id").take(pa.array(np.repeat(rows, len(sets)))),
                pa.array((score + shift).reshape(-1))], ["set_id", "cell_id", "score"])
    return cells.mapInArrow(run, f"set_id {block.kind}, cell_id {dict(cells.dtypes)['cell_id']}, score double")


def block_moments(cells: DataFrame, block: Block, shift: np.ndarray | float = 0.0) -> DataFrame:
    """set_id, t, q: sums of a block's shifted scores and of their squares over all cells. A task adds up its own cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, q = np.zeros(len(block.sets)), np.zeros(len(block.sets))
        for _, score in _products(batches, block):
            t += (score + shift).sum(axis=0)
            q += ((score + shift) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([block.sets, pa.array(t), pa.array(q)], ["set_id", "t", "q"])
    return cells.mapInArrow(run, f"set_id {block.kind}, t double, q double").groupBy("set_id").agg(
        F.sum("t").alias("t"), F.sum("q").alias("q"))


def module_score(m: Matrix, genes: DataFrame, nbin: int = BINS, ctrl: int = CONTROLS) -> DataFrame:
    """cell_id, score of one set(gene, pos)."""
    return score_many(m, genes.withColumn("set_id", F.lit("set")), nbin, ctrl).drop("set_id")


def score_grid(scores: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Mean score per set and population."""
    return scores.join(cells.select("cell_id", *by), "cell_id").groupBy("set_id", *by).agg(
        F.avg("score").alias("mean"))


def score_summary(scores: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """n, mean and index quantiles of the score per set and population."""
    rows = scores.join(cells.select("cell_id", *by), "cell_id").withColumn("score", F.col("score").cast("float"))
    keys = ["set_id", *by]
    marks = index_quantiles(rows, keys, "score", {"min": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "max": 1.0})
    means = rows.groupBy(*keys).agg(F.avg(F.col("score").cast("double")).alias("mean"))
    return marks.join(means, keys)


def score_clip(scores: DataFrame) -> DataFrame:
    """Colour range of a score map: the values at 1 and 99 per cent."""
    rows = scores.withColumn("score", F.col("score").cast("float"))
    return index_quantiles(rows, ["set_id"], "score", {"lo": 0.01, "hi": 0.99})
