"""Objects that come in parts: checking the parts, joining them into one matrix, dealing one out.

A collection is three frames. ``cells`` has (part, local_id, type, sample, cond, ...),
``expr`` (part, gene, local_id, value) and ``genes`` (part, gene, pos). Cell ids of the
whole follow from the parts' sizes; everything is a join or an aggregate by part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.matrix import Matrix
from tallygrid.operators.prep import labelled_only
from tallygrid.plans.ordering import numbered


class Parts(NamedTuple):
    cells: DataFrame
    expr: DataFrame
    genes: DataFrame


def gene_lists(genes: DataFrame) -> DataFrame:
    """part, n, h: size and order-aware digest of each part's gene list, added up gene by gene."""
    return genes.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("gene", "pos").cast("decimal(38,0)")).alias("h"))


def differing_lists(genes: DataFrame) -> DataFrame:
    """part: those whose gene list differs from the first part's."""
    lists = gene_lists(genes)
    first = lists.agg(F.min_by(F.struct("n", "h"), "part").alias("v")).select("v").scalar()
    return lists.where((F.col("n") != first["n"]) | (F.col("h") != first["h"])).select("part")


def violations(parts: Parts) -> DataFrame:
    """part, rule: every rule a part breaks."""
    cells, expr, genes = parts
    twice = cells.groupBy("part", "local_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    broken = (
        ("gene list", differing_lists(genes)),
        ("value outside the cells", expr.select("part", "local_id").distinct().join(cells, ["part", "local_id"], "left_anti")),
        ("value outside the genes", expr.select("part", "gene").distinct().join(genes, ["part", "gene"], "left_anti")),
        ("repeated cell", twice),
        ("cell without a label", cells.where("type IS NULL OR sample IS NULL OR cond IS NULL")),
    )
    out = None
    for rule, rows in broken:
        mine = rows.select("part").distinct().withColumn("rule", F.lit(rule))
        out = mine if out is None else out.unionByName(mine)
    return out


def columns_in_every_part(meta: DataFrame) -> DataFrame:
    """Extra columns that all parts of meta(part, columns) carry."""
    n = meta.agg(F.count_distinct("part").alias("n")).select("n").scalar()
    return meta.select("part", F.explode("columns").alias("column")).groupBy("column").agg(
        F.count_distinct("part").alias("parts")).where(F.col("parts") == n)


def offsets(cells: DataFrame) -> DataFrame:
    """part, first_id: cells of the parts before, in part order."""
    sizes = cells.groupBy("part").agg((F.max("local_id") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))


def ingest(parts: Parts) -> Matrix:
    """All parts as one object. A sample two parts place in different conditions keeps the first part's.

    ``violations`` tells beforehand whether the parts agree.
    """
    first = offsets(parts.cells)
    place = (F.col("first_id") + F.col("local_id")).alias("cell_id")
    extra = [c for c in parts.cells.columns if c not in ("part", "local_id", "cell_id")]
    cells = parts.cells.join(first, "part").select("part", place, *extra)
    owner = cells.groupBy("sample").agg(F.min_by("cond", "cell_id").alias("cond"))
    cells = labelled_only(cells.drop("cond").join(owner, "sample"))
    lead = parts.genes.agg(F.min("part").alias("v")).scalar()
    genes = parts.genes.where(F.col("part") == lead).select("gene", F.col("pos").cast("long").alias("gene_id"))
    return Matrix(parts.expr.join(first, "part").select("gene", place, "value"), cells, genes)


def assign_parts(cells: DataFrame, parts: int) -> DataFrame:
    """``part`` per cell: whole samples in turn when there are enough of them, else contiguous blocks."""
    sizes = cells.groupBy("sample").agg(F.min("cell_id").alias("first"))
    turn = (F.row_number().over(Window.orderBy("first")) - 1) % parts
    by_sample = sizes.select("sample", turn.cast("long").alias("_turn"))
    samples = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    block = F.floor(F.col("_at") * parts / total)
    return numbered(cells, [], "cell_id", out="_at").join(by_sample, "sample").withColumn(
        "part", F.when(samples >= parts, F.col("_turn")).otherwise(block)).select(*cells.columns, "part")


def dealt(m: Matrix, cells: DataFrame) -> Parts:
    """The object as parts; ``cells`` are its cells with a ``part``. Levels are those of the part's own cells."""
    cells = numbered(cells, ["part"], "cell_id", out="local_id")
    place = cells.select("cell_id", "part", "local_id")
    expr = m.nonzero().join(place, "cell_id").select("part", "gene", "local_id", "value")
    pos = numbered(m.genes, [], "gene_id", out="pos")
    names = cells.agg(F.collect_set("part").alias("v")).scalar()
    return Parts(cells.drop("cell_id"), expr, pos.select(F.explode(names).alias("part"), "gene", "pos"))


def split_parts(m: Matrix, path: str, parts: int) -> None:
    """Each part's expression, cells and genes under their own folder."""
    for name, frame in zip(Parts._fields, dealt(m, assign_parts(m.cells, parts))):
        frame.write.partitionBy("part").parquet(f"{path}/{name}")


def read_parts(spark, path: str) -> Parts:
    return Parts(*(spark.read.parquet(f"{path}/{name}") for name in Parts._fields))
