"""Densities, distances and trees for figures with many small panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.matrix import Matrix
from tallygrid.plans.ordering import index_quantiles
from tallygrid.plans.pairs import pair_sums
from tallygrid.plans.session import cut_lineage

GRID_STEPS = 26
# Largest number of rows one panel's tree is built over.
MAX_LEAVES = 2000


def value_counts(m: Matrix, genes=None, by: str = "type") -> DataFrame:
    """gene, grp, value, k: how often each value occurs in each group, zeros by arithmetic."""
    expr = m.nonzero() if genes is None else m.panel(genes).where("value <> 0")
    labels = m.cells.where(F.col(by).isNotNull()).select("cell_id", F.col(by).alias("grp"))
    seen = expr.join(labels, "cell_id").groupBy("gene", "grp", "value").agg(F.count(F.lit(1)).alias("k"))
    sizes = labels.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    asked = m.genes.select("gene") if genes is None else (
        m.genes.where(F.col("gene").isin(genes)).select("gene") if isinstance(genes, list)
        else genes.select("gene").distinct())
    groups = sizes.agg(F.collect_list(F.struct("grp", "n")).alias("g")).scalar()
    slots = asked.withColumn("g", F.explode(groups)).select("gene", "g.grp", "g.n")
    zeros = slots.join(seen.groupBy("gene", "grp").agg(F.sum("k").alias("d")), ["gene", "grp"], "left").select(
        "gene", "grp", F.lit(0.0).cast("float").alias("value"), (F.col("n") - F.coalesce("d", F.lit(0))).alias("k"))
    return seen.unionByName(zeros.where("k > 0"))


def bandwidth(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Silverman's rule per group of weighted values (keys, value, k): keys, n, h, lo, hi.

    Every value counts; quartiles come from value buckets, so a group of any size is never
    ordered in one task.
    """
    v, k = F.col("value").cast("double"), F.col("k")
    quarter = index_quantiles(counts, keys, "value", {"q1": 0.25, "q3": 0.75}, weight="k").drop("n")
    stat = counts.groupBy(*keys).agg(
        F.sum("k").alias("n"), F.sum(k * v).alias("s"), F.sum(k * v * v).alias("q"),
        F.min("value").alias("lo"), F.max("value").alias("hi")).join(quarter, keys)
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sd = F.when((F.col("n") > 1) & (F.col("hi") > F.col("lo")), F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(0.0)
    stat = stat.withColumns({"sd": sd, "iqr": F.col("q3").cast("double") - F.col("q1")})
    spread = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.349)).otherwise(F.col("sd"))
    h = F.when((F.col("n") >= 2) & (spread > 0), 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return stat.select(*keys, "n", F.coalesce(h, F.lit(0.0)).alias("h"), "lo", "hi")


def violin_density(m: Matrix, genes=None, by: str = "type") -> DataFrame:
    """Density outline of each gene per group on a 27-point grid: gene, grp, step, width in [0, 1].

    All values of a group count. The grid runs from the lower of 0 and the gene's least value
    to its greatest. The kernel is cut at four bandwidths and the outline at the observed range.
    """
    keys = ["gene", "grp"]
    counts = cut_lineage(value_counts(m, genes, by))
    span = counts.groupBy("gene").agg(
        F.least(F.lit(0.0), F.min("value").cast("double")).alias("a"), F.max("value").cast("double").alias("b"))
    stat = bandwidth(counts, keys).join(span, "gene")
    v, k = F.col("value").cast("double"), F.col("k")
    x = lambda step: F.col("a") + (F.col("b") - F.col("a")) * step / GRID_STEPS

    def mass(step: int):
        z = (v - x(step)) / F.col("h")
        return F.sum(F.when(F.abs(z) <= 4, k * F.exp(-0.5 * z * z)).otherwise(0.0))

    facts = ["h", "lo", "hi", "a", "b"]
    # One sum per grid point, in one pass over the distinct values.
    shaped = counts.join(stat, keys).groupBy(*keys, *facts).agg(
        F.array(*[mass(step) for step in range(GRID_STEPS + 1)]).alias("mass"))
    grid = shaped.select(*keys, *facts, F.posexplode("mass").alias("step", "m"))
    width = F.when(F.col("b") == F.col("a"), 1.0).otherwise(F.col("b") - F.col("a"))
    flat_at = F.floor((F.col("lo") - F.col("a")) / width * GRID_STEPS + 0.5)
    at = x(F.col("step"))
    outline = F.when(F.col("h") <= 0, F.when(F.col("step") == flat_at, 1.0).otherwise(0.0)).when(
        (at < F.col("lo")) | (at > F.col("hi")), 0.0).otherwise(F.col("m"))
    grid = grid.withColumn("outline", outline)
    top = F.max("outline").over(Window.partitionBy(*keys))
    return grid.select(*keys, "step", (F.col("outline") / F.when(top == 0, 1.0).otherwise(top)).alias("width"))


# ---- distances and trees ----


def distances(panels: DataFrame, metric: str = "correlation") -> DataFrame:
    """Row-by-row distances of each panel(panel, row, col, value): panel, row_a < row_b, d.

    The table of pairs is the result; a column a row lacks is zero, and a flat row is at
    distance 2 from every other.
    """
    rows = panels.select(F.col("panel").alias("grp"), F.col("row").cast("string").alias("row"), "col", "value")
    columns = rows.groupBy("grp").agg(F.count_distinct("col").alias("n"))
    pairs = pair_sums(rows, columns).where("row_a < row_b")
    if metric == "euclidean":
        d = F.sqrt("square")
    else:
        flat = F.least("norm_a", "norm_b") <= 1e-12 * F.sqrt("n")
        r = F.col("cov") / (F.col("norm_a") * F.col("norm_b"))
        d = F.when(flat, 2.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pairs.select(F.col("grp").alias("panel"), "row_a", "row_b", d.alias("d"))


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, list[int]]]:
    """Average-linkage merges (node_a, node_b, height, leaves), smaller child first in the leaf order."""
    n = len(d)
    work = d.astype(float).copy()
    np.fill_diagonal(work, np.inf)
    node = list(range(n))
    leaves = {i: [i] for i in range(n)}
    alive = np.ones(n, dtype=bool)
    order = np.arange(n)  # nodes are compared in the order they came to be
    merges = []
    for new in range(n, 2 * n - 1):
        live = np.flatnonzero(alive)
        live = live[np.argsort(order[live], kind="stable")]
        block = work[np.ix_(live, live)]
        block[np.tril_indices(len(live))] = np.inf
        i, j = np.unravel_index(np.argmin(block), block.shape)
        p, q = live[i], live[j]
        a, b = node[p], node[q]
        height = float(block[i, j])
        na, nb = len(leaves[a]), len(leaves[b])
        leaves[new] = leaves[b] + leaves[a] if na > nb else leaves[a] + leaves[b]
        merges.append((a, b, height, leaves[new]))
        joined = (na * work[p] + nb * work[q]) / (na + nb)
        work[p, :], work[:, p] = joined, joined
        work[p, p] = np.inf
        alive[q] = False
        node[p], order[p] = new, new
    return merges


def cluster_order(panels: DataFrame, metric: str = "correlation", most_rows: int = MAX_LEAVES) -> DataFrame:
    """Average-linkage tree of each panel with three rows or more: panel, step, a, b, height, leaves.

    The distances come from ``distances``; one task merges one panel. A panel of more than
    ``most_rows`` rows is beyond a figure: its one row has no step.
    """
    schema = "panel string, step int, a int, b int, height double, leaves array<string>"
    sizes = panels.groupBy("panel").agg(F.count_distinct("row").alias("rows"))
    # Panels without a tree are left out before any distance is formed.
    drawn = sizes.where(F.col("rows").between(3, most_rows)).select("panel")
    shown = distances(panels.join(drawn, "panel", "left_semi"), metric)

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pairs["row_a"], *pairs["row_b"]})
        at = {v: k for k, v in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = pairs["row_a"].map(at).to_numpy(), pairs["row_b"].map(at).to_numpy()
        d[i, j] = d[j, i] = pairs["d"].to_numpy()
        merges = average_linkage(d)
        return pd.DataFrame({
            "panel": pairs["panel"].iloc[0], "step": range(len(merges)), "a": [m[0] for m in merges],
            "b": [m[1] for m in merges], "height": [m[2] for m in merges],
            "leaves": [[names[i] for i in m[3]] for m in merges]})

    beyond = sizes.where(F.col("rows") > most_rows).select(
        "panel", *[F.lit(None).cast(t).alias(c) for c, t in
                   (("step", "int"), ("a", "int"), ("b", "int"), ("height", "double"), ("leaves", "array<string>"))])
    return shown.groupBy("panel").applyInPandas(solve, schema).unionByName(beyond)
