"""Merging the level lists of several parts into one ordered list."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def union_levels(parts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """level, ord for parts(part, ord, level).

    With a recorded order known(level, ord): its levels that occur, then unknown ones
    in first-appearance order. Without: an order that agrees with every part.
    """
    first = parts.groupBy("level").agg(F.min(F.struct("part", "ord")).alias("at"))
    if known is not None:
        placed = first.join(known.withColumnRenamed("ord", "k"), "level", "left")
        order = Window.orderBy(F.col("k").asc_nulls_last(), "at")
        return placed.select("level", (F.row_number().over(order) - 1).alias("ord"))
    step = Window.partitionBy("part").orderBy("ord")
    pairs = parts.withColumn("next", F.lead("level").over(step)).where("next IS NOT NULL AND next <> level").select(
        "level", "next").distinct()
    # The level names themselves are the result: one list, ordered as a whole.
    seen = [r["level"] for r in first.orderBy("at").collect()]
    order = merged_order(seen, [(r["level"], r["next"]) for r in pairs.collect()])
    return parts.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], "level string, ord int")


def natural(name: str) -> tuple:
    """Digit runs compare as numbers, case is ignored, then the exact spelling decides."""
    parts = re.split(r"(\d+)", name.lower())
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in parts if p), name


def merged_order(seen: list[str], follows: list[tuple[str, str]]) -> list[str]:
    """Topological order of the level names, ties by natural name; a cycle's levels keep first appearance."""
    after, waiting = defaultdict(set), dict.fromkeys(seen, 0)
    for a, b in follows:
        if b not in after[a]:
            after[a].add(b)
            waiting[b] += 1
    ready = [(natural(v), v) for v in seen if waiting[v] == 0]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        _, level = heapq.heappop(ready)
        out.append(level)
        for nxt in after[level]:
            waiting[nxt] -= 1
            if waiting[nxt] == 0:
                heapq.heappush(ready, (natural(nxt), nxt))
    return out + [v for v in seen if v not in set(out)]


def recode(cells: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """Replace a level by its place in the merged order, kept beside the name."""
    codes = levels.select(F.col("level").alias(column), F.col("ord").alias(f"{column}_ord"))
    return cells.join(codes, column, "left")


def sample_conflicts(cells: DataFrame) -> DataFrame:
    """sample, cond kept (the first part's), and cells labelled otherwise; cells carry a ``part``."""
    fine = cells.groupBy("sample", "cond").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
    kept = fine.groupBy("sample").agg(F.min_by("cond", F.struct("part", "cond")).alias("kept"), F.sum("n").alias("n"))
    return fine.join(kept.select("sample", "kept"), "sample").groupBy("sample", "kept").agg(
        F.sum(F.when(F.col("cond") != F.col("kept"), F.col("n")).otherwise(0)).alias("conflicts"))
