"""The one container: a long table of non-zero values beside labelled observations."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that a stored matrix deals its genes into, by a hash of the name.
PARTS = 32


@dataclass(frozen=True)
class Matrix:
    """Lazy frames only.

    expr   gene, cell_id, value FLOAT      non-zeros; a stored 0 behaves as absent
    cells  cell_id, type, sample, cond, ...  one row per observation
    genes  gene, gene_id                   every feature measured, all-zero ones included
    dealt  expr with gene_part             of a stored matrix: the folder of each gene
    rows   cell_id, genes, values          of a source that has its cells as rows: the same values
    """

    expr: DataFrame
    cells: DataFrame
    genes: DataFrame
    dealt: DataFrame | None = None
    rows: DataFrame | None = None

    def with_cells(self, cells: DataFrame) -> "Matrix":
        return replace(self, cells=cells)

    def nonzero(self) -> DataFrame:
        return self.expr.where(F.col("value") != 0)

    def labelled(self, labels: DataFrame) -> DataFrame:
        """Non-zeros of the cells of ``labels``, each with its cell's labels. Cells that the source has as
        rows meet their labels as such, and not value by value."""
        if self.rows is None:
            return self.nonzero().join(labels, "cell_id")
        met = self.rows.join(labels, "cell_id")
        named = met.select(*labels.columns, F.inline(F.arrays_zip("genes", "values"))).withColumnsRenamed({"genes": "gene", "values": "value"})
        return named.where(F.col("value") != 0)

    def panel(self, genes: DataFrame | list[str]) -> DataFrame:
        """Expression rows of some genes. Of a stored matrix only the folders of these genes are read: a list
        is pushed into the scan, and a frame prunes the scan while the query runs, by Spark's dynamic
        partition pruning, where the planner broadcasts it."""
        columns = ["gene", "cell_id", "value"]
        if isinstance(genes, list):
            wanted = F.col("gene").isin(genes)
            if self.dealt is None:
                return self.expr.where(wanted)
            parts = sorted({zlib.crc32(str(g).encode()) % PARTS for g in genes})
            return self.dealt.where(F.col("gene_part").isin(parts) & wanted).select(columns)
        asked = genes.select("gene").distinct()
        if self.dealt is None:
            return self.expr.join(asked, "gene", "left_semi")
        asked = asked.withColumn("gene_part", gene_part(F.col("gene")))
        return self.dealt.join(asked, ["gene_part", "gene"], "left_semi").select(columns)

    def write(self, path: str) -> None:
        """Parquet in a folder per part of the genes, ordered by gene within, so that a gene read is one
        folder and row-group statistics turn it into a slice of that.

        Ranges split on the cell too, so a common gene spans files. Their number follows
        the data: shuffle partitions, coalesced by adaptive execution.
        """
        keys = ["gene_part", "gene", "cell_id"]
        (self.expr.withColumn("gene_part", gene_part(F.col("gene"))).repartitionByRange(*keys)
         .sortWithinPartitions(*keys).write.partitionBy("gene_part").parquet(f"{path}/expr"))
        self.cells.write.parquet(f"{path}/cells")
        self.genes.write.parquet(f"{path}/genes")

    @staticmethod
    def read(spark, path: str) -> "Matrix":
        dealt, cells, genes = (spark.read.parquet(f"{path}/{t}") for t in ("expr", "cells", "genes"))
        return Matrix(dealt.drop("gene_part"), cells, genes, dealt)


def gene_part(gene: Column) -> Column:
    return F.pmod(F.crc32(gene.cast("string").cast("binary")), F.lit(PARTS)).cast("int")


def scope(cells: DataFrame, types: list[str] | None = None, conds: list[str] | str | None = None) -> DataFrame:
    """Cells of the chosen types and conditions; ``None`` means every one, an empty list means none."""
    if types is not None:
        cells = cells.where(F.col("type").isin(list(types)) if types else F.lit(False))
    if conds is not None:
        conds = [conds] if isinstance(conds, str) else list(conds)
        cells = cells.where(F.col("cond").isin(conds) if conds else F.lit(False))
    return cells


def sides_overlap(a: list[str] | str | None, b: list[str] | str | None) -> bool:
    """Two sides that share a level, or a side with none, are not a comparison."""
    left = {a} if isinstance(a, str) else set(a or ())
    right = {b} if isinstance(b, str) else set(b or ())
    return not left or not right or bool(left & right)
