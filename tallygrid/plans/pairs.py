"""Covariances of all pairs of rows within groups, by joins on the columns they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a column, and of a group, in one block; a task joins one block with one.
BLOCK = 1000


def block_joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of rows (row_a of ``left``, row_b of ``right``) that agree on ``keys``, as products of blocks;
    both sides hold the same rows.

    Rows of a key are dealt into blocks of about ``BLOCK``, and each pair of blocks is a join key of its
    own. So a column that very many rows share, or a group of very many rows, is spread over as many
    tasks as the square of its blocks; a short one has one block and costs nothing more."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = lambda row: F.pmod(F.xxhash64(row), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = left.join(sizes, keys).withColumn("block_a", own("row_a")).withColumn("block_b", every).drop("blocks")
    b = right.join(sizes, keys).withColumn("block_b", own("row_b")).withColumn("block_a", every).drop("blocks")
    return a.join(b, [*keys, "block_a", "block_b"]).drop("block_a", "block_b")


def pair_sums(rows: DataFrame, columns: DataFrame | Column) -> DataFrame:
    """grp, row_a <= row_b, cov, norm_a, norm_b, square for rows(grp, row, col, value).

    A column without a value of a row counts as zero. ``columns`` is the number of columns,
    one for all groups or a frame (grp, n). ``cov`` is the sum of products of deviations,
    ``square`` the sum of squared differences. The pairs are the result; only columns that
    both rows have are joined, block by block, and what the others add follows from each row's own sums.
    """
    n = rows.withColumn("n", columns) if isinstance(columns, Column) else rows.join(columns, "grp")
    mean = n.groupBy("grp", "row", "n").agg(F.sum("value").alias("sum")).select(
        "grp", "row", "n", (F.col("sum") / F.col("n")).alias("mean"))
    dev = rows.join(mean, ["grp", "row"]).select(
        "grp", "row", "col", "value", "n", "mean", (F.col("value") - F.col("mean")).alias("dev"))
    stat = dev.groupBy("grp", "row", "n", "mean").agg(
        F.count(F.lit(1)).alias("k"), F.sum("dev").alias("s"), F.sum(F.col("dev") * F.col("dev")).alias("q"),
        F.sum(F.col("value") * F.col("value")).alias("v"))
    stat = stat.withColumn("norm", F.sqrt(F.col("q") + (F.col("n") - F.col("k")) * F.col("mean") * F.col("mean")))
    side = lambda df, x: df.select("grp", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "grp"])
    cell = dev.select("grp", "row", "col", "dev", "value")
    left, right = side(cell, "a"), side(cell, "b")
    a, b = F.col("dev_a"), F.col("dev_b")
    shared = block_joined(left.withColumnRenamed("col_a", "col"), right.withColumnRenamed("col_b", "col"), ["grp", "col"])
    both = shared.where("row_a <= row_b").groupBy("grp", "row_a", "row_b").agg(
        F.count(F.lit(1)).alias("c"), F.sum(a).alias("ca"), F.sum(b).alias("cb"), F.sum(a * b).alias("cab"),
        F.sum((F.col("value_a") - F.col("value_b")) * (F.col("value_a") - F.col("value_b"))).alias("gap"),
        F.sum(F.col("value_a") * F.col("value_a")).alias("va"), F.sum(F.col("value_b") * F.col("value_b")).alias("vb"))
    pairs = block_joined(side(stat, "a"), side(stat.drop("n"), "b"), ["grp"]).where("row_a <= row_b")
    pairs = pairs.join(both, ["grp", "row_a", "row_b"], "left").na.fill(0, ["c", "ca", "cb", "cab", "gap", "va", "vb"])
    ma, mb = F.col("mean_a"), F.col("mean_b")
    neither = F.col("n_a") - F.col("k_a") - F.col("k_b") + F.col("c")
    cov = F.col("cab") - (F.col("s_a") - F.col("ca")) * mb - (F.col("s_b") - F.col("cb")) * ma + neither * ma * mb
    square = F.greatest(F.lit(0.0), F.col("gap") + (F.col("v_a") - F.col("va")) + (F.col("v_b") - F.col("vb")))
    return pairs.select("grp", "row_a", "row_b", cov.alias("cov"), "norm_a", "norm_b", square.alias("square"),
                        F.col("n_a").alias("n"))
