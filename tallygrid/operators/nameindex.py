"""An inverted index over the short substrings of names, for searches by a part of a name.

Every name is filed under each of its distinct substrings of one, two and three characters, case
aside. A search intersects the lists of the trigrams of its words (of a shorter word, the word
itself) and leaves the candidates to be verified by whoever asks. The lists are dealt into
folders by the substring and ordered by it within, so a search reads a few row groups of a few
folders, never all names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.plans.session import shared_path

#: Length of the longest substring, and folders of lists.
LONGEST, FOLDERS = 3, 16


class NameIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.lists = spark.read.parquet(path)
        self.columns = self.lists.schema["entry"].dataType.names

    @classmethod
    def build(cls, names: DataFrame, searched: list[Column], path: str | None = None) -> NameIndex:
        """Write the index of the rows of ``names`` by the texts ``searched``, below ``path`` or in the shared folder."""
        spark = names.sparkSession
        path = path or shared_path(spark, "names")
        found = F.array_distinct(F.flatten(F.array(*[parts(F.lower(F.coalesce(t, F.lit("")))) for t in searched])))
        filed = names.select(F.struct(*names.columns).alias("entry"), F.explode(found).alias("part"))
        folder = F.pmod(F.crc32(F.col("part").cast("binary")), F.lit(FOLDERS)).cast("int")
        # A common substring's list is as long as the table of names; ranges split on the entry too.
        (filed.withColumn("folder", folder).repartitionByRange("folder", "part", F.xxhash64("entry"))
         .sortWithinPartitions("folder", "part").write.partitionBy("folder").parquet(path))
        return cls(spark, path)

    def candidates(self, words: list[str]) -> DataFrame:
        """The rows filed under all substrings of all words; rows without one of the words may be among them.
        Without a word, no rows."""
        asked = sorted({p for w in words for p in query_parts(w.lower())})
        folders = sorted({zlib.crc32(p.encode()) % FOLDERS for p in asked})
        listed = self.lists.where(F.col("folder").isin(folders) & F.col("part").isin(asked)) if asked else self.lists.limit(0)
        # Rows that are equal in every column count once per substring and are one candidate.
        met = listed.groupBy("entry").agg(F.count_distinct("part").alias("n"))
        return met.where(F.col("n") == len(asked)).select("entry.*")


def parts(text: Column) -> Column:
    """All substrings of 1 to ``LONGEST`` characters."""
    size = F.length(text)

    def of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda start: F.substr(text, start, F.lit(n)))
        return F.when(size >= n, each).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*map(of, range(1, LONGEST + 1))))


def query_parts(word: str) -> list[str]:
    return [word[k:k + LONGEST] for k in range(max(1, len(word) - LONGEST + 1))] if word else []
