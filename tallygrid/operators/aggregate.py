"""Grouped summaries over cells and over expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.matrix import Matrix
from tallygrid.plans.ordering import index_quantiles, numbered

QUARTILES = {"min": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "max": 1.0}


# ---- cells ----


def cells_per(cells: DataFrame, column: str, levels: DataFrame | list | None = None) -> DataFrame:
    """Cells per level; levels named, in a list or a frame with ``level``, but empty stay with 0."""
    counts = cells.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("cells"))
    if levels is None:
        return counts
    known = levels if isinstance(levels, DataFrame) else cells.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    return known.join(counts, "level", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def grid_proportions(cells: DataFrame) -> DataFrame:
    """type, sample, cells, prop: each type's share of the sample, absent pairs included as zero."""
    pairs = cells.groupBy("type", "sample").agg(F.count(F.lit(1)).alias("cells"))
    types = pairs.agg(F.collect_set("type").alias("v")).scalar()
    # A sample's list has one entry per type, as the grid of the result has.
    per = pairs.groupBy("sample").agg(
        F.sum("cells").alias("total"), F.collect_list(F.struct("type", "cells")).alias("seen"))
    absent = F.transform(F.array_except("types", F.col("seen.type")),
                         lambda t: F.struct(t.alias("type"), F.lit(0).cast("long").alias("cells")))
    return per.withColumn("types", types).select("sample", "total", F.explode(F.concat("seen", absent)).alias("e")).select(
        "e.type", "sample", "e.cells", (F.col("e.cells") / F.col("total")).alias("prop"))


def sample_conditions(cells: DataFrame) -> DataFrame:
    """sample, cond: the condition of the sample's first cell."""
    return cells.groupBy("sample").agg(F.min_by("cond", "cell_id").alias("cond"))


def min_replicates(cells: DataFrame, conds: DataFrame | list | None = None) -> DataFrame:
    """One row: fewest samples in any condition, a condition without samples counting 0."""
    per = sample_conditions(cells).groupBy("cond").agg(F.count(F.lit(1)).alias("n"))
    if conds is not None:
        known = conds if isinstance(conds, DataFrame) else cells.sparkSession.createDataFrame([(c,) for c in conds], "cond string")
        per = known.join(per, "cond", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.agg(F.min("n").alias("min_replicates"))


def type_facets(cells: DataFrame) -> DataFrame:
    """Per type and condition: mean, least and greatest sample proportion."""
    props = grid_proportions(cells).join(sample_conditions(cells), "sample")
    return props.groupBy("type", "cond").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("prop").alias("mean"),
        F.min("prop").alias("lo"), F.max("prop").alias("hi"))


def design(cells: DataFrame, types: list, control: list, compare: list, min_cells: int = 10, min_samples: int = 4) -> DataFrame:
    """Samples of each side of a contrast over the chosen types, and whether a replicate-level test is sound."""
    of = sample_conditions(cells).where(F.col("cond").isin([*control, *compare]))
    n = cells.where(F.col("type").isin(types)).groupBy("sample").agg(F.count(F.lit(1)).alias("cells"))
    used = of.join(n, "sample", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    kept = F.col("cells") >= min_cells
    apart = not set(control) & set(compare)
    return used.agg(
        F.count(F.lit(1)).alias("used"), F.count_if(kept).alias("kept"),
        F.count_if(kept & F.col("cond").isin(control)).alias("n0"),
        F.count_if(kept & F.col("cond").isin(compare)).alias("n1"),
    ).withColumn("pb_ok", (F.col("n0") >= min_samples) & (F.col("n1") >= min_samples) & F.lit(apart))


def has_signal(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: does it vary at all."""
    flags = cells.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    return flags.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(False)).alias("varies")) for c in columns
    ])).alias("s")).select("s.*")


def qc_summary(cells: DataFrame, columns: list[str], by: str = "sample") -> DataFrame:
    """Index quantiles of each covariate per sample, one row per (sample, covariate)."""
    long = cells.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("covariate"), F.col(c).cast("float").alias("value")) for c in columns])).alias("s"))
    return index_quantiles(long.select(by, "s.*"), [by, "covariate"], "value", QUARTILES)


def centroids(cells: DataFrame, by: str = "type") -> DataFrame:
    """Upper median of x and of y per group."""
    long = cells.select(by, F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").cast("float").alias("value")),
        F.struct(F.lit("y").alias("axis"), F.col("y").cast("float").alias("value")))).alias("s"))
    med = index_quantiles(long.select(by, "s.*"), [by, "axis"], "value", {"med": 0.5})
    return med.groupBy(by).agg(
        F.max(F.when(F.col("axis") == "x", F.col("med"))).alias("x"),
        F.max(F.when(F.col("axis") == "y", F.col("med"))).alias("y"), F.max("n").alias("cells"))


def extent(cells: DataFrame, pad: float = 0.4) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return cells.agg((F.min(x) - pad).alias("x0"), (F.max(x) + pad).alias("x1"),
                     (F.min(y) - pad).alias("y0"), (F.max(y) + pad).alias("y1"))


def embedding_points(cells: DataFrame, colour: str, q: float = 0.99) -> DataFrame:
    """Points with a colour field scaled by its q-th percentile of positive values, and the shared extent."""
    top = cells.where(F.col(colour) > 0).select(F.col(colour).cast("float").alias("v"))
    ceiling = index_quantiles(top, [], "v", {"top": q}).select("top").scalar()
    ends = extent(cells)
    return cells.select(
        "cell_id", "x", "y", "cond",
        F.least(F.lit(1.0), F.col(colour) / F.coalesce(ceiling, F.lit(1.0)).cast("double")).alias("shade"),
        *[ends.select(c).scalar().alias(c) for c in ("x0", "x1", "y0", "y1")])


def embedding_by_key(cells: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    """Cells with the coordinates of the chosen embedding."""
    chosen = coordinates.where(F.col("key") == key).select("cell_id", "x", "y")
    return cells.drop("x", "y").join(chosen, "cell_id")


# ---- expression ----


def dot_grid(m: Matrix, genes: DataFrame | list | None = None, by: str = "type") -> DataFrame:
    """Mean and share of cells above zero for genes x levels, absent pairs included.

    One aggregate by (gene, level); the zero pairs come from the level dictionary.
    """
    expr = m.expr if genes is None else m.panel(genes)
    n = m.cells.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    levels = n.agg(F.collect_list("grp").alias("v")).scalar()
    values = expr.join(m.cells.select("cell_id", F.col(by).alias("grp")), "cell_id").where("grp IS NOT NULL")
    pairs = values.groupBy("gene", "grp").agg(
        F.sum(F.col("value").cast("double")).alias("s"), F.count_if(F.col("value") > 0).alias("d"))
    seen = pairs.groupBy("gene").agg(F.collect_list(F.struct("grp", "s", "d")).alias("seen"))
    if genes is None:
        asked = m.genes.select("gene")
    else:
        asked = (m.genes.where(F.col("gene").isin(genes)) if isinstance(genes, list)
                 else m.genes.join(genes.select("gene").distinct(), "gene", "left_semi")).select("gene")
    have = F.coalesce("seen", F.array().cast(seen.schema["seen"].dataType))
    absent = F.transform(
        F.array_except("levels", F.col("have.grp")),
        lambda g: F.struct(g.alias("grp"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("d")))
    full = asked.join(seen, "gene", "left").withColumns({"have": have, "levels": levels})
    return (
        full.select("gene", F.explode(F.concat("have", absent)).alias("e")).select("gene", "e.*").join(n, "grp")
        .select("gene", "grp", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("d") / F.col("n")).alias("pct"))
    )


def gene_in_group(m: Matrix, by: list[str]) -> DataFrame:
    """Mean and detection of every gene in every group that expresses it: a point read, for all at once."""
    n = m.cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sums = m.expr.join(m.cells.select("cell_id", *by), "cell_id").groupBy("gene", *by).agg(
        F.sum(F.col("value").cast("double")).alias("s"), F.count_if(F.col("value") > 0).alias("d"))
    return sums.join(n, by).select(
        "gene", *by, "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("d") / F.col("n")).alias("pct"))


def identity_stats(m: Matrix, genes: DataFrame | list | None, group_by: str, within: str | None = None) -> DataFrame:
    """A gene's mean and detection per type, per condition inside one type, or per type x condition."""
    if group_by == "type":
        return dot_grid(m, genes, "type")
    if group_by == "cond":
        return dot_grid(m.with_cells(m.cells.where(F.col("type") == within)), genes, "cond")
    return dot_grid(m.with_cells(m.cells.withColumn("both", F.concat_ws(" | ", "type", "cond"))), genes, "both")


def nonzero_percentile(m: Matrix, q: float = 0.99) -> DataFrame:
    """Colour ceiling per gene: the q-th percentile of its positive values; 1 when it has none."""
    # Equal values of a gene are one row before they are placed.
    seen = m.expr.where(F.col("value") > 0).groupBy("gene", "value").agg(F.count(F.lit(1)).alias("k"))
    top = index_quantiles(seen, ["gene"], "value", {"ceiling": q}, "k")
    return m.genes.select("gene").join(top, "gene", "left").select(
        "gene", F.coalesce(F.col("ceiling"), F.lit(1.0).cast("float")).alias("ceiling"))


def stride_sample(cells: DataFrame, by: str, most: int) -> DataFrame:
    """Every ``max(1, floor(n / most))``-th cell of each group, in cell order: cell_id, grp, k."""
    placed = numbered(cells.where(F.col(by).isNotNull()).select("cell_id", F.col(by).alias("grp")),
                      ["grp"], "cell_id", out="pos")
    steps = cells.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("grp")).agg(
        F.greatest(F.lit(1), F.expr(f"count(1) div {int(most)}")).alias("step"))
    return placed.join(steps, "grp").where("pos % step = 0").select(
        "cell_id", "grp", F.expr("pos div step").alias("k"))


def violin_values(m: Matrix, genes: DataFrame | list | None = None, by: str = "type", most: int = 400) -> DataFrame:
    """Evenly strided cells of each group with each gene's value, zeros included: gene, grp, k, value.

    Each group keeps fewer than 2*most cells, so the zero-filled result is genes x that.
    """
    picked = stride_sample(m.cells, by, most)
    expr = m.expr if genes is None else m.panel(genes)
    asked = m.genes.select("gene") if genes is None else (
        m.genes.where(F.col("gene").isin(genes)).select("gene") if isinstance(genes, list)
        else genes.select("gene").distinct())
    values = expr.join(picked, "cell_id").groupBy("gene", "grp").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))
    lengths = picked.groupBy("grp").agg(F.max("k").alias("last"))
    groups = lengths.agg(F.collect_list(F.struct("grp", "last")).alias("g")).select("g").scalar()
    slots = asked.select("gene", F.explode(groups).alias("g")).select("gene", "g.grp", "g.last")
    filled = slots.join(values, ["gene", "grp"], "left")
    return filled.select(
        "gene", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("k"), "at").select(
        "gene", "grp", "k", F.coalesce(F.try_element_at("at", F.col("k")), F.lit(0.0).cast("float")).alias("value"))


def feature_cells(m: Matrix, gene: str, floor: float = 0.0, top: float | None = None,
                  cond: str | None = None, types: list | None = None) -> DataFrame:
    """A feature panel's cells in drawing order: value scaled into [0, 1], cells outside the panel flagged."""
    values = m.panel([gene]).select("cell_id", "value")
    inside = F.lit(True)
    if cond is not None:
        inside = inside & (F.col("cond") == cond)
    if types is not None:
        inside = inside & F.col("type").isin(types)
    if top is None:
        top_col = nonzero_percentile(Matrix(m.panel([gene]), m.cells, m.genes.where(F.col("gene") == gene))).select(
            F.col("ceiling").cast("double")).scalar()
    else:
        top_col = F.lit(float(top))
    span = F.when(top_col > floor, top_col - floor).otherwise(1.0)
    v = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    return (
        m.cells.join(values, "cell_id", "left").withColumn("in_panel", inside).withColumn("value", v)
        .withColumn("shade", F.when(F.col("in_panel"), F.least(F.lit(1.0), F.greatest(
            F.lit(0.0), (F.col("value") - floor) / span))))
        .select("cell_id", "in_panel", "value", "shade").orderBy("in_panel", "value", "cell_id"))


def relative_expression(m: Matrix, control: str) -> DataFrame:
    """Mean of every gene per condition divided by its mean in the control (1 when that is 0)."""
    grid = dot_grid(m, by="cond")
    base = grid.where(F.col("grp") == control).select(
        "gene", F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")).alias("base"))
    return grid.join(base, "gene").select("gene", "grp", (F.col("mean") / F.col("base")).alias("relative"))


def log2_ratio(m: Matrix, first: str, last: str) -> DataFrame:
    """log2 of the last condition's mean over the first's, each lifted by 0.05."""
    grid = dot_grid(m, by="cond").groupBy("gene").agg(
        F.max(F.when(F.col("grp") == first, F.col("mean"))).alias("a"),
        F.max(F.when(F.col("grp") == last, F.col("mean"))).alias("b"))
    return grid.select("gene", F.log2((F.col("b") + 0.05) / (F.col("a") + 0.05)).alias("log2_ratio"))


# ---- scaling along rows ----

Z_CLIP, FLAT = 2.5, 1e-12


def z_by_row(df: DataFrame, row: list[str], value: str) -> DataFrame:
    """z over the columns kept of each row, clipped; a flat row is zero."""
    w = Window.partitionBy(*row)
    sd = F.stddev_pop(value).over(w)
    z = F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), (F.col(value) - F.avg(value).over(w)) / sd))
    return df.withColumn("z", F.when(sd > FLAT, z).otherwise(0.0))


def dot_scaled(grid: DataFrame, row: str = "gene", value: str = "mean") -> DataFrame:
    """Dot-plot scaling per gene: like z, but a flat gene is divided by one."""
    w = Window.partitionBy(row)
    raw = F.stddev_pop(value).over(w)
    sd = F.when(raw == 0, 1.0).otherwise(raw)
    return grid.withColumn("scaled", F.greatest(F.lit(-Z_CLIP), F.least(
        F.lit(Z_CLIP), (F.col(value) - F.avg(value).over(w)) / sd)))


def dot_spread(grid: DataFrame) -> DataFrame:
    """Genes whose means range widest and narrowest over the groups."""
    per = grid.groupBy("gene").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = F.round(F.col("hi") - F.col("lo"), 9)
    return per.agg(
        F.max_by("gene", F.struct(width, F.col("gene"))).alias("widest"), F.max(width).alias("widest_by"),
        F.min_by("gene", F.struct(width, F.col("gene"))).alias("narrowest"), F.min(width).alias("narrowest_by"))


def fine_partition(m: Matrix) -> DataFrame:
    """Sums at the finest grain (gene, type, cond); any drawn column is a union of these parts."""
    return m.expr.join(m.cells.select("cell_id", "type", "cond"), "cell_id").groupBy("gene", "type", "cond").agg(
        F.sum(F.col("value").cast("double")).alias("s"), F.count_if(F.col("value") > 0).alias("d"))


def aggregate_columns(parts: DataFrame, cells: DataFrame, by: list[str],
                      keep_types: list | DataFrame | None = None, keep_conds: list | DataFrame | None = None) -> DataFrame:
    """Column means from fine parts: hidden types and conditions drop out before sums and sizes add up.
    The levels kept are a list or a frame with that column."""
    def shown(df: DataFrame) -> DataFrame:
        for column, keep in (("type", keep_types), ("cond", keep_conds)):
            if isinstance(keep, DataFrame):
                df = df.join(keep.select(column).distinct(), column, "left_semi")
            elif keep is not None:
                df = df.where(F.col(column).isin(keep))
        return df

    size = shown(cells).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return shown(parts).groupBy("gene", *by).agg(F.sum("s").alias("s")).join(size, by).select(
        "gene", *by, "n", (F.col("s") / F.col("n")).alias("mean"))


def per_gene(expr: DataFrame, fn, schema: str) -> DataFrame:
    """User hook: a pandas function over batches of non-zeros, run where the rows lie.

    ``fn`` sees any number of genes at once and returns partial rows per gene, which
    the caller combines with an ordinary aggregate. No gene is gathered in one task.
    """
    return expr.mapInPandas(lambda batches: (fn(batch) for batch in batches), schema)


# ---- plans that share a scan ----


@dataclass(frozen=True)
class GenePlan:
    """One statistic per gene, as the three steps that let several share one scan and several parts one result.

    ``partial`` gives aggregates over non-zeros (column ``value``), ``merge`` how two partials of a
    gene become one, and ``finish`` the statistic from the merged columns and the number of cells.
    """

    name: str
    partial: Callable[[], dict[str, Column]]
    finish: Callable[[Callable[[str], Column], Column], Column]
    merge: Callable[[Column], Column] = F.sum

    def columns(self) -> dict[str, Column]:
        return {f"{self.name}_{k}": v for k, v in self.partial().items()}


def _value() -> Column:
    return F.col("value").cast("double")


#: Mean over all cells, cells with a positive value, standard deviation over all cells, largest value seen.
AVERAGE = GenePlan("avg", lambda: {"sum": F.sum(_value())}, lambda c, n: c("sum") / n)
DETECTION = GenePlan("pct", lambda: {"hits": F.count_if(F.col("value") > 0)}, lambda c, n: c("hits") / n)
DEVIATION = GenePlan(
    "sd", lambda: {"sum": F.sum(_value()), "square": F.sum(_value() * _value())},
    lambda c, n: F.sqrt(F.greatest(F.lit(0.0), c("square") / n - (c("sum") / n) * (c("sum") / n))))
LARGEST = GenePlan("top", lambda: {"top": F.max(_value())}, lambda c, n: c("top"), merge=F.max)


def gene_partials(expr: DataFrame, plans: list[GenePlan]) -> DataFrame:
    """gene and the partial columns of all plans, in one aggregation of one scan."""
    columns = {k: v for p in plans for k, v in p.columns().items()}
    return expr.groupBy("gene").agg(*[v.alias(k) for k, v in columns.items()])


def merge_partials(partials: DataFrame, plans: list[GenePlan]) -> DataFrame:
    """One row per gene from partials of several parts of a matrix, or of several runs."""
    return partials.groupBy("gene").agg(*[p.merge(F.col(k)).alias(k) for p in plans for k in p.columns()])


def finish_plans(partials: DataFrame, plans: list[GenePlan], cells: Column) -> DataFrame:
    """gene and one column per plan, named as the plan."""
    return partials.select("gene", *[
        p.finish(lambda k, p=p: F.col(f"{p.name}_{k}"), cells).alias(p.name) for p in plans])


def run_plans(m: Matrix, plans: list[GenePlan]) -> DataFrame:
    """Every plan over every gene that has a value: one scan and one shuffle however many plans there are."""
    n = m.cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return finish_plans(gene_partials(m.expr, plans), plans, n)
