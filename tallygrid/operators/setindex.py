"""An inverted index of a library of sets over one background, written once and asked many times.

``postings`` has a row for each background symbol that any set mentions: the symbol in upper
case and the sets that hold it, each with its size inside the background. It is partitioned by
a bucket of the symbol, so that a query reads the buckets of its own symbols and no others.
``sizes`` has a row per set. Folding the library against the background, which costs two
shuffles of all members, happens when the index is built and not when it is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.sets import annotated_background, folded_members
from tallygrid.plans.session import shared_path

#: Buckets of symbols; a bucket of a library of a hundred million symbols has some three million.
BUCKETS = 32


class SetIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.sizes = spark.read.parquet(f"{path}/sizes")

    @classmethod
    def build(cls, members: DataFrame, background: DataFrame, path: str | None = None) -> SetIndex:
        """Write the index of ``members`` over ``background`` below ``path``, or in the shared folder.

        A set id that several collections carry belongs to the first; symbols that only dropped
        collections mention are annotated all the same and stand in no set."""
        spark = members.sparkSession
        path = path or shared_path(spark, "sets")
        inside = folded_members(members, background)
        named = ["source", "set_id", "set_name"]
        inside.groupBy(*named).agg(F.count(F.lit(1)).alias("set_size")).write.parquet(f"{path}/sizes")
        # A symbol's list is bounded by the number of sets.
        lists = inside.join(spark.read.parquet(f"{path}/sizes"), named).groupBy("u").agg(
            F.collect_list(F.struct(*named, "set_size")).alias("sets"))
        none = F.array().cast(lists.schema["sets"].dataType)
        annotated_background(background, members).join(lists, "u", "left").select(
            "u", F.coalesce("sets", none).alias("sets"), bucket(F.col("u")).alias("bucket"),
        ).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
        return cls(spark, path)

    def population(self) -> Column:
        """The number of annotated background symbols; read from the files' footers."""
        return self.postings.agg(F.count(F.lit(1)).alias("v")).scalar()

    def find(self, symbols: DataFrame) -> DataFrame:
        """The rows of ``symbols`` (u, ...) that are annotated, with their sets. ``symbols`` is read twice."""
        asked = symbols.withColumn("bucket", bucket(F.col("u")))
        # At most BUCKETS numbers; they prune the files that are read.
        wanted = [row["bucket"] for row in asked.select("bucket").distinct().collect()]
        return asked.join(self.postings.where(F.col("bucket").isin(wanted)), ["bucket", "u"]).drop("bucket")


def bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")
