"""Parts that arrive over time: additive pseudobulk sums kept up to date by a file stream.

An object split into parts is presented as one; its pseudobulk columns add across
parts. As parts land in a folder, each micro-batch is summed and appended as one
partial table; reading the object adds the partials, so a replayed batch overwrites
its own partial and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PART_SCHEMA = "part string, gene string, sample string, type string, n_cells bigint, count double"


def watch_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PART_SCHEMA).parquet(path)


def keep_totals(parts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's column sums below ``out``; runs until the parts present are used up."""
    def add(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("part", "gene", "sample", "type").agg(
            F.max("n_cells").alias("n_cells"), F.sum("count").alias("count")
        ).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (parts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """The partials of every batch, ready for ``prep.merge_pseudobulk``."""
    return spark.read.parquet(out).drop("epoch")
