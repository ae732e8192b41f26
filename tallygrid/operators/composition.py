"""Composition tables: what each row of a design is made of, and whether it pools samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.ranktest import MIN_CELLS_PER_SIDE
from tallygrid.operators.sets import safe_name

ROLES = ("type", "cond", "sample")


def fields(cells: DataFrame, extras: list[str] = ()) -> list[str]:
    """Fields offered: type, condition when it varies, extras with two levels or more, sample."""
    counted = ["cond", *extras]
    n = cells.agg(*[F.count_distinct(c).alias(c) for c in counted]).first()
    return ["type", *[c for c in counted if n[c] > 1], "sample"]


def row_axes(offered: list[str], part: str) -> list[list[str]]:
    """Single fields, then ordered pairs; a sample already determines its condition."""
    others = [f for f in offered if f != part]
    pairs = [[a, b] for a in others for b in others if a != b and (a, b) != ("sample", "cond")]
    return [[f] for f in others] + pairs


def composition(cells: DataFrame, part: str, rows: list[str]) -> DataFrame:
    """rows..., part, cells, row_total, samples, only_sample, fraction for the combinations that hold cells.

    Cells collapse to (rows, part, sample) first; everything after works on that.
    """
    keys = [F.col(r).alias(f"row{i}") for i, r in enumerate(rows)]
    names = [f"row{i}" for i in range(len(rows))]
    fine = cells.groupBy(*keys, F.col(part).alias("part"), F.col("sample").alias("_sample")).agg(
        F.count(F.lit(1)).alias("n"))
    parts = fine.groupBy(*names, "part").agg(F.sum("n").alias("cells"))
    totals = fine.groupBy(*names).agg(
        F.sum("n").alias("row_total"), F.count_distinct("_sample").alias("samples"),
        F.min("_sample").alias("_one"))
    return parts.join(totals, names).select(
        *names, "part", "cells", "row_total", "samples",
        F.when(F.col("samples") == 1, F.col("_one")).alias("only_sample"),
        (F.col("cells") / F.col("row_total")).alias("fraction"))


def composition_flags(cells: DataFrame, part: str, rows: list[str]) -> DataFrame:
    """One row: how much the table pools samples, whether it says anything, how many rows were possible."""
    table = composition(cells, part, rows)
    names = [f"row{i}" for i in range(len(rows))]
    per_row = table.groupBy(*names).agg(
        F.max("samples").alias("samples"), F.max("row_total").alias("n"), F.count(F.lit(1)).alias("parts"))
    levels = [cells.agg(F.count_distinct(r).alias("n")).select("n").scalar() for r in rows]
    n_parts = cells.agg(F.count_distinct(part).alias("n")).select("n").scalar()
    spread = (
        cells.select(*[F.col(r).alias(f"row{i}") for i, r in enumerate(rows)], F.col("sample").alias("s")).distinct()
        .groupBy("s").agg(F.count(F.lit(1)).alias("rows"))
        .agg(F.count_if(F.col("rows") > 1).alias("spanning")))
    flags = per_row.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("samples") > 1).alias("pooled_rows"),
        F.coalesce(F.max("samples"), F.lit(0)).alias("worst_pool"),
        F.count_if(F.col("n") < MIN_CELLS_PER_SIDE).alias("thin"),
        F.coalesce(F.max("parts") <= 1, F.lit(True)).alias("single"))
    flags = flags.withColumn("possible", reduce(lambda a, b: a * b, levels)).withColumn(
        "degenerate", F.col("single") & (n_parts > 1)).withColumn(
        "spanning_samples", spread.select("spanning").scalar())
    return flags.select(
        "rows", "possible", "pooled_rows", "worst_pool", "spanning_samples", "degenerate", "thin",
        (F.lit(len(rows) > 1) & (F.col("rows") * 2 < F.col("possible"))).alias("sparse"),
        ((F.col("pooled_rows") > 0) & F.lit(part != "sample")).alias("refused"))


def every_pairing(cells: DataFrame, extras: list[str] = ()) -> DataFrame:
    """Counts of every pair of fields in one pass: grouping sets over the finest grain."""
    names = ["type", "cond", *extras, "sample"]
    fine = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    pairs = [[a, b] for i, a in enumerate(names) for b in names[i + 1:]]
    return fine.groupingSets([[F.col(c) for c in p] for p in pairs], *[F.col(c) for c in names]).agg(
        F.sum("n").alias("cells"), F.grouping_id(*names).alias("pairing"))


def default_rows(cells: DataFrame, part: str, extras: list[str] = ()) -> list[str]:
    """First row axis that does not pool samples; the first of all when every one does.

    Axes are few (fields squared), and each check is one aggregate.
    """
    axes = row_axes(fields(cells, list(extras)), part)
    for axis in axes:
        if not composition_flags(cells, part, axis).first()["refused"]:
            return axis
    return axes[0]


def export_header(part: str, rows: list[str]) -> list[str]:
    """Unique column names of the export; a carried column goes by its own, file-safe name."""
    fixed = ["cells", "row_total", "samples", "fraction"]
    out: list[str] = []
    for field in [*rows, part]:
        base = field if field in ROLES else safe_name(field)
        name, k = base, 2
        while name in out or name in fixed:
            name, k = f"{base}-{k}", k + 1
        out.append(name)
    return out + fixed
