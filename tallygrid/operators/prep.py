"""Normalising, classifying and labelling a matrix before analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def lognormalize(counts: DataFrame) -> DataFrame:
    """gene, cell_id, value: log1p of counts per ten thousand of the cell's total.

    Totals come from a partial aggregate joined back, so a cell with very many
    features is never gathered in one window.
    """
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("_total"))
    share = F.col("count") * 1e4 / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))
    return counts.join(totals, "cell_id").select("gene", "cell_id", F.log1p(share).cast("float").alias("value"))


def recover_counts(logged: DataFrame) -> DataFrame:
    """Counts behind a log1p(count) matrix, rounded half to even."""
    return logged.select("gene", "cell_id", F.bround(F.expm1(F.col("value").cast("double"))).alias("count"))


def log_linear(linear: DataFrame) -> DataFrame:
    """log1p of a matrix that is normalised but not logged."""
    return linear.select("gene", "cell_id", F.log1p("value").cast("float").alias("value"))


def _whole(v: Column, atol: float) -> Column:
    near = F.rint(v)
    return F.abs(v - near) <= atol + 1e-5 * F.abs(near)


def classify(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: what the numbers say the matrix holds, judged on every non-zero value."""
    v = F.col(value).cast("double")
    facts = values.where(v != 0).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.min(_whole(v, 1e-8)).alias("whole"),
        # expm1 overflows past 700; a value that large is not the log of a count.
        F.min(F.when(v < 700, _whole(F.expm1(F.least(v, F.lit(700.0))), 1e-3)).otherwise(False)).alias("logged"),
    )
    kind = (
        F.when(F.col("n") == 0, "lognorm").when(F.col("lo") < 0, "scaled").when(F.col("whole"), "counts")
        .when(F.col("logged"), "log-counts").when(F.col("hi") < 50, "lognorm").otherwise("linear")
    )
    return facts.select("n", "lo", "hi", kind.alias("kind"))


def choose_matrix(candidates: dict[str, DataFrame]) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """(display values, raw counts, kinds) from named candidate matrices.

    Display: a log-normalised matrix as it stands, else one normalised from counts,
    else the logarithm of a linear one. A scaled matrix serves for nothing.
    """
    kinds = {name: classify(df).first()["kind"] for name, df in candidates.items()}
    by_kind: dict[str, DataFrame] = {}
    for name, kind in kinds.items():
        by_kind.setdefault(kind, candidates[name])
    counts = None
    if "counts" in by_kind:
        counts = by_kind["counts"].select("gene", "cell_id", F.col("value").cast("double").alias("count"))
    elif "log-counts" in by_kind:
        counts = recover_counts(by_kind["log-counts"])
    if "lognorm" in by_kind:
        display = by_kind["lognorm"]
    elif counts is not None:
        display = lognormalize(counts)
    elif "linear" in by_kind:
        display = log_linear(by_kind["linear"])
    else:
        display = None
    return display, counts, kinds


def qc(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell with its total count and number of detected genes."""
    sums = counts.groupBy("cell_id").agg(
        F.sum("count").alias("n_counts"), F.count_if(F.col("count") > 0).alias("n_genes"))
    return cells.join(sums, "cell_id", "left").withColumns({
        "n_counts": F.coalesce("n_counts", F.lit(0.0)), "n_genes": F.coalesce("n_genes", F.lit(0)),
    })


def mito_percent(cells: DataFrame, column: str = "pct_mito") -> DataFrame:
    """A proportion becomes a percentage when no cell exceeds one."""
    top = cells.agg(F.max(column)).first()[0]
    return cells.withColumn(column, F.col(column) * 100) if top is not None and top <= 1 else cells


def split_spanning(cells: DataFrame) -> DataFrame:
    """Give a sample that spans conditions one id per condition; other samples keep theirs."""
    spread = cells.groupBy("sample").agg(F.count_distinct("cond").alias("_n"))
    spanning = spread.where("_n > 1").select("sample", F.lit(True).alias("_spans"))
    renamed = F.when(F.col("_spans"), F.concat_ws("|", "sample", "cond")).otherwise(F.col("sample"))
    return cells.join(spanning, "sample", "left").withColumn("sample", renamed).drop("_spans")


def extra_column(cells: DataFrame, column: str) -> DataFrame:
    """Cells per level of one more column; no annotation is a level of its own."""
    return (
        cells.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("level"))
        .agg(F.count(F.lit(1)).alias("cells"))
    )


def carried_columns(cells: DataFrame, columns: list[str], most_levels: int = 65_535) -> DataFrame:
    """Columns that can travel with the cells: at least two levels, no annotation counted as one, and
    no more than a 16-bit code can tell apart."""
    levels = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("NA"))).alias(c) for c in columns]
    long = cells.agg(*levels).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("levels")) for c in columns])).alias("s")).select("s.*")
    return long.where(F.col("levels").between(2, most_levels))


def groupings(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that group the cells: between 2 and 1000 levels, and fewer than 0.9 per cell."""
    wide = cells.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(c).alias(c) for c in columns])
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("levels")) for c in columns])).alias("s"))
    return long.where((F.col("s.levels") >= 2) & (F.col("s.levels") <= 1000)
                      & (F.col("s.levels") < 0.9 * F.greatest(F.col("_n"), F.lit(1)))).select("s.column", "s.levels")


def level_order(cells: DataFrame, column: str) -> DataFrame:
    """Levels in first-appearance order: level, ord."""
    first = cells.groupBy(F.col(column).alias("level")).agg(F.min("cell_id").alias("_at"))
    return first.select("level", (F.row_number().over(Window.orderBy("_at")) - 1).alias("ord"))


def labelled_only(cells: DataFrame) -> DataFrame:
    """Drop cells that carry no type."""
    return cells.where(F.col("type").isNotNull())


def pseudobulk(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Summed counts per gene, sample and type, with the cells behind each column."""
    labels = cells.select("cell_id", "sample", "type")
    sizes = pseudobulk_sizes(cells)
    sums = counts.join(labels, "cell_id").groupBy("gene", "sample", "type").agg(F.sum("count").alias("count"))
    return sums.join(sizes, ["sample", "type"]).select("gene", "sample", "type", "n_cells", "count")


def pseudobulk_sizes(cells: DataFrame) -> DataFrame:
    """Cells behind each (sample, type) column, columns without a single count included."""
    return cells.groupBy("sample", "type").agg(F.count(F.lit(1)).alias("n_cells"))


def merge_pseudobulk(parts: DataFrame, columns: DataFrame | None = None, part_genes: DataFrame | None = None) -> DataFrame:
    """Union of several parts' columns; counts add, and so do the cells behind a shared column.

    ``parts`` carries a ``part`` column. ``columns`` (part, sample, type, n_cells) lists
    every part's columns; without it they are read off the rows, once per part and
    not once per gene, and a part's column that holds no count at all goes unseen.
    ``part_genes`` (part, gene) lists the genes of every part: with it nothing is
    merged unless each part has columns and all parts have the same genes.
    """
    if columns is None:
        columns = parts.groupBy("part", "sample", "type").agg(F.max("n_cells").alias("n_cells"))
    sizes = columns.groupBy("sample", "type").agg(F.sum("n_cells").alias("n_cells"))
    sums = parts.groupBy("gene", "sample", "type").agg(F.sum("count").alias("count"))
    merged = sums.join(sizes, ["sample", "type"]).select("gene", "sample", "type", "n_cells", "count")
    return merged if part_genes is None else merged.where(_alike(columns, part_genes).scalar())


def _alike(columns: DataFrame, part_genes: DataFrame) -> DataFrame:
    """One boolean: does every part have columns, and every gene occur in every part."""
    carried = columns.select("part").distinct().withColumn("_carried", F.lit(True))
    per_gene = part_genes.select("part", "gene").distinct().join(carried, "part", "left").groupBy("gene").agg(
        F.count("_carried").alias("n"))
    every = part_genes.agg(F.count_distinct("part")).scalar()
    return per_gene.agg(F.coalesce(F.min("n"), F.lit(0)).alias("n")).select((F.col("n") == every).alias("alike"))


def repoint(cells: DataFrame, type_col: str | None = None, cond_col: str | None = None) -> DataFrame:
    """Use other columns as the type or condition roles."""
    if type_col:
        cells = cells.withColumn("type", F.col(type_col).cast("string"))
    if cond_col:
        cells = cells.withColumn("cond", F.col(cond_col).cast("string"))
    return cells


def groupable(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: is it constant within every sample, and so able to act as a condition?"""
    per = cells.groupBy("sample").agg(*[
        (F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))).alias(c)
        for c in columns])
    flags = per.agg(*[F.min(c).alias(c) for c in columns])
    return flags.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("groupable")) for c in columns])).alias("s")).select("s.*")


def reorder(levels: DataFrame, order: list[str]) -> DataFrame:
    """Levels (level, ord) rearranged: named ones first in the order given, the rest as they were."""
    named = F.array(*[F.lit(o) for o in dict.fromkeys(order)]) if order else F.array().cast("array<string>")
    place = F.array_position(named, F.col("level"))
    key = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    return levels.select("level", (F.row_number().over(Window.orderBy(key, "ord")) - 1).alias("ord"))
