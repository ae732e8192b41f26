"""Pseudobulk tables in and result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.ranktest import combined_score, significant

# Fixed value: p-values below this are written as a bound.
P_FLOOR = 1e-308


def read_pseudobulk(spark: SparkSession, path: str) -> DataFrame:
    """gene, sample, type, n_cells, count of a wide table whose headers join sample, type and cells by ``||``."""
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, *columns = wide.columns
    long = wide.select(F.col(f"`{gene}`").alias("gene"), F.explode(F.array(*[
        F.struct(F.split(F.lit(c), r"\|\|").alias("h"), F.col(f"`{c}`").cast("double").alias("count"))
        for c in columns])).alias("e"))
    return long.select(
        "gene", F.col("e.h")[0].alias("sample"), F.col("e.h")[1].alias("type"),
        F.coalesce(F.try_element_at("e.h", F.lit(3)).cast("int"), F.lit(0)).alias("n_cells"),
        F.coalesce("e.count", F.lit(0.0)).alias("count"))


def pseudobulk_columns(pb: DataFrame, cells: DataFrame, cluster: str | None, control: list, compare: list,
                       min_cells: int = 10) -> DataFrame:
    """Columns of one cluster, or of every cluster, on either side of a contrast that hold enough cells."""
    of = cells.groupBy("sample").agg(F.min_by("cond", "cell_id").alias("cond"))
    return (pb if cluster is None else pb.where(F.col("type") == cluster)).select("sample", "type", "n_cells").distinct().join(of, "sample").where(
        F.col("cond").isin([*control, *compare]) & (F.col("n_cells") >= min_cells))


def pseudobulk_wide(pb: DataFrame, columns: DataFrame) -> DataFrame:
    """One column per sample, named ``sample__cond``; the column list is one cluster's samples."""
    named = columns.select("sample", "type", F.concat_ws("__", "sample", "cond").alias("_c"))
    names = [r["_c"] for r in named.select("_c").distinct().orderBy("_c").collect()]
    return pb.join(named, ["sample", "type"]).groupBy("gene").pivot("_c", names).agg(
        F.sum("count")).na.fill(0)


def export_pseudobulk(pb: DataFrame, cells: DataFrame, control: list, compare: list, path: str, min_cells: int = 10) -> None:
    """Every cluster's table of a contrast in one job: a folder per cluster, and in it a line (gene, column,
    count) for each gene the cluster has counts of and each of its columns, zeros included."""
    named = pseudobulk_columns(pb, cells, None, control, compare, min_cells).select(
        "sample", "type", F.concat_ws("__", "sample", "cond").alias("column"))
    counts = pb.join(named, ["sample", "type"]).groupBy("type", "gene", "column").agg(F.sum("count").alias("count"))
    grid = counts.select("type", "gene").distinct().join(named.select("type", "column").distinct(), "type")
    full = grid.join(counts, ["type", "gene", "column"], "left").select(
        "gene", "column", F.coalesce("count", F.lit(0.0)).alias("count"), "type")
    full.repartition("type", "gene").write.partitionBy("type").csv(path, sep="\t", header=True)


def p_text(p: Column) -> Column:
    """A p-value for a file: a bound once it has underflowed, empty when untested."""
    return F.when(p < P_FLOOR, f"<{P_FLOOR:.0e}").when(p.isNotNull(), exponential(p)).otherwise("")


def printed(v: Column, form: str) -> Column:
    """A number as C's printf writes it: rounded from its exact binary value, ties to even. ``format_string``
    rounds the shortest decimal half up, so that 0.5625 or a value computed as 0.12345 may end in another digit."""
    return F.udf(lambda x: None if x is None else format(x, form), "string")(v.cast("double"))


def exponential(v: Column) -> Column:
    """Four decimals and an exponent without padding zeros, e.g. 1.2346e-7."""
    return F.regexp_replace(printed(v, ".4e"), r"e([+-])0(\d)$", "e$1$2")


def nlp_text(nlp: Column) -> Column:
    return F.coalesce(printed(nlp, ".4f"), F.lit(""))


def _fixed(column: str, digits: int) -> Column:
    return F.coalesce(printed(F.col(column), f".{digits}f"), F.lit(""))


def deg_table(de: DataFrame, compare: str, control: str) -> DataFrame:
    side = F.when(F.col("lfc") > 0, f"higher in {compare}").otherwise(f"higher in {control}")
    return de.withColumn("combined", combined_score()).select(
        "gene", _fixed("pct1", 4).alias("pct.1"), _fixed("pct2", 4).alias("pct.2"), _fixed("lfc", 4).alias("log2FC"),
        _fixed("combined", 3).alias("combined"), p_text(F.col("p")).alias("p"), p_text(F.col("padj")).alias("padj"),
        p_text(F.col("fdr")).alias("fdr_BH"), nlp_text(F.col("nlp")).alias("neg_log10_padj"), side.alias("direction"))


def markers_table(de: DataFrame) -> DataFrame:
    return de.where(significant() & (F.col("lfc") > 0)).select(
        F.col("grp").alias("cluster"), "gene", _fixed("lfc", 4).alias("log2FC"), _fixed("pct1", 4).alias("pct.1"),
        _fixed("pct2", 4).alias("pct.2"), p_text(F.col("p")).alias("p"), p_text(F.col("padj")).alias("padj"),
        nlp_text(F.col("nlp")).alias("neg_log10_padj"))


def enrichment_table(terms: DataFrame) -> DataFrame:
    return terms.select(
        F.col("set_name").alias("set"), F.col("set_id").alias("id"), "source", F.col("overlap_size").alias("overlap"),
        F.col("set_size").alias("setSize"), _fixed("fold", 3).alias("foldEnrichment"),
        exponential(F.col("p")).alias("p"), exponential(F.col("padj")).alias("padj"),
        F.array_join("overlap", " ").alias("genes"))


def composition_table(table: DataFrame, header: list[str]) -> DataFrame:
    rows = [c for c in table.columns if c.startswith("row") and c[3:].isdigit()]
    out = table.select(*rows, "part", "cells", "row_total", "samples", _fixed("fraction", 6).alias("fraction"))
    return out.toDF(*header)


def scores_table(summary: DataFrame, identity: str) -> DataFrame:
    return summary.select(
        F.col(identity).alias("identity"), F.col("n").alias("cells"), _fixed("med", 4).alias("median"),
        _fixed("mean", 4).alias("mean"), _fixed("q1", 4).alias("q1"), _fixed("q3", 4).alias("q3"))


def coexpression_table(ends: DataFrame, method: str = "pearson") -> DataFrame:
    return ends.select(
        "gene", _fixed("r", 4).alias(f"{method}_r"), _fixed("pct", 4).alias("detected"),
        F.when(F.col("member"), "yes").otherwise("no").alias("is_seed_member"))


def export_csv(df: DataFrame, path: str) -> None:
    """Parallel CSV files with a header each."""
    df.write.csv(path, header=True)
