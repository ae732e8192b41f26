"""Co-expression axes: which bucket each cell falls in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.plans.ordering import value_bucket
from tallygrid.plans.session import cut_lineage

MIN_CELLS_PER_POOL = 10
WANTED_POOLS = 256


class Axis(NamedTuple):
    assign: DataFrame        # cell_id, bucket
    sizes: DataFrame | None  # bucket, n; None on the per-cell axis
    pooled: bool


def cell_axis(cells: DataFrame) -> Axis:
    """Every cell in scope is its own bucket."""
    return Axis(cells.select("cell_id", F.col("cell_id").alias("bucket")), None, False)


def group_axis(cells: DataFrame, by: str = "cond", min_cells: int = MIN_CELLS_PER_POOL) -> Axis:
    """One bucket per type x level that holds enough cells."""
    sizes = cells.groupBy("type", F.col(by).alias("level")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_cells)
    sizes = sizes.withColumn("bucket", F.row_number().over(Window.orderBy("type", "level")) - 1)
    assign = cells.select("cell_id", "type", F.col(by).alias("level")).join(sizes, ["type", "level"])
    return Axis(assign.select("cell_id", "bucket"), sizes.select("bucket", "n"), True)


def pool_axis(cells: DataFrame, want: int = WANTED_POOLS, within: list[str] | None = None) -> Axis:
    """Metacells: blocks of cells cut at proportional medians of the wider coordinate.

    ``cells`` carries cell_id, x, y and the columns of ``within``, whose combinations
    never share a pool. Every level of cuts is a few aggregates over all nodes at
    once; the cut itself is an exact order statistic found by narrowing value
    buckets, so a block of any size is never sorted in one task.
    """
    keys = within or []
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    points = cells.select(
        "cell_id", group.alias("grp"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    room = F.floor(F.col("n") / MIN_CELLS_PER_POOL)
    share = F.greatest(F.lit(1).cast("long"), F.least(room, F.floor(F.lit(want) * F.col("n") / F.col("total") + 0.5)))
    nodes = sizes.withColumn("total", total).where(room >= 1).select(
        "grp", F.lit("").alias("path"), F.col("n"), share.alias("k"),
        F.lit(False).alias("by_x"), F.lit(False).alias("by_y"))
    nodes = cut_lineage(nodes)
    points = points.join(nodes.select("grp", "path"), "grp")
    done: list[DataFrame] = []
    while True:
        splitting = nodes.where("k > 1 AND n >= 2")
        done.append(nodes.where("NOT (k > 1 AND n >= 2)"))
        if splitting.isEmpty():
            break
        cuts = cut_lineage(_cuts(points, splitting))
        here = points.join(cuts.select("grp", "path", "axis", "tie", "a", "b", "id"), ["grp", "path"], "left")
        main = F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y"))
        other = F.when(F.col("tie"), F.when(F.col("axis") == "x", F.col("y")).otherwise(F.col("x"))).otherwise(
            F.lit(0.0).cast("float"))
        left = (main < F.col("a")) | ((main == F.col("a")) & (
            (other < F.col("b")) | ((other == F.col("b")) & (F.col("cell_id") <= F.col("id")))))
        step = F.when(F.col("a").isNull(), "").when(left, "0").otherwise("1")
        points = cut_lineage(here.select("cell_id", "grp", F.concat("path", step).alias("path"), "x", "y"))
        first = F.shiftright("k", 1)
        halves = F.explode(F.array(
            F.struct(F.lit("0").alias("side"), F.col("cut").alias("n"), first.alias("k")),
            F.struct(F.lit("1").alias("side"), (F.col("n") - F.col("cut")).alias("n"), (F.col("k") - first).alias("k"))))
        nodes = cuts.select(
            "grp", "path", halves.alias("h"),
            (F.col("by_x") | (F.col("axis") == "x")).alias("by_x"),
            (F.col("by_y") | (F.col("axis") == "y")).alias("by_y"),
        ).select("grp", F.concat("path", "h.side").alias("path"), "h.n", "h.k", "by_x", "by_y")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    leaves = leaves.select("grp", "path", "n")
    leaves = leaves.withColumn(
        "bucket", F.row_number().over(Window.orderBy("grp", "path")) - 1)
    assign = points.join(leaves, ["grp", "path"]).select("cell_id", "bucket")
    return Axis(assign, leaves.select("bucket", "n"), True)


def _cuts(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's cut: axis, number of cells on the left, and the last cell there as (a, b, id).

    Cells are ordered by the wider coordinate, then - as in a stable re-sort of an
    already sorted block - by the other one if an ancestor was cut along it, then by id.
    """
    key = ["grp", "path"]
    span = points.join(nodes.select(*key), key).groupBy(*key).agg(
        (F.max("x").cast("double") - F.min("x")).alias("wx"), (F.max("y").cast("double") - F.min("y")).alias("wy"))
    k1 = F.shiftright("k", 1)
    cut = F.greatest(F.lit(1).cast("long"), F.least(
        F.col("n") - 1, F.floor(F.col("n") * k1 / F.col("k") + 0.5)))
    axis = F.when(F.col("wx") >= F.col("wy"), "x").otherwise("y")
    nodes = nodes.join(span, key).withColumn("axis", axis).withColumn("cut", cut).withColumn(
        "tie", F.when(F.col("axis") == "x", F.col("by_y")).otherwise(F.col("by_x"))).drop("wx", "wy")
    nodes = cut_lineage(nodes)
    along = F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y"))
    across = F.when(F.col("tie"), F.when(F.col("axis") == "x", F.col("y")).otherwise(F.col("x"))).otherwise(
        F.lit(0.0).cast("float"))
    rows = points.join(nodes.select(*key, "axis", "tie"), key).select(
        *key, along.alias("a"), across.alias("b"), F.col("cell_id").alias("id"),
        value_bucket(along).alias("ab"), value_bucket(across).alias("bb"), F.shiftright("cell_id", 16).alias("block"))
    want = nodes.select(*key, F.col("cut").alias("pos"))
    found = want
    # Narrow each node to the bucket, value and finally the one cell at its position.
    for column in ("ab", "a", "bb", "b", "block", "id"):
        known = [c for c in found.columns if c not in (*key, "pos")]
        counts = rows.join(found, [*key, *known]).groupBy(*key, *known, "pos", column).agg(
            F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*key).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        picked = counts.withColumn("_cum", F.sum("_c").over(upto)).where(
            (F.col("pos") > F.col("_cum") - F.col("_c")) & (F.col("pos") <= F.col("_cum")))
        found = cut_lineage(picked.select(*key, *known, column, (F.col("pos") - F.col("_cum") + F.col("_c")).alias("pos"),
                                          F.col("_c").alias("_left")))
        alone = found.agg(F.max("_left")).first()[0] == 1
        found = found.drop("_left")
        if alone:
            # One cell left per node: its remaining columns need no further counting.
            known = [c for c in found.columns if c not in (*key, "pos")]
            found = rows.join(found.drop("pos"), [*key, *known]).select(*key, "a", "b", "id")
            break
    return nodes.join(found.select(*key, "a", "b", "id"), key)
