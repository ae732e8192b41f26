"""Exact order-based plans that never sort one whole group in one task.

Ranks, quantiles, row numbers and step-up corrections all need an order inside a
group, and one group may hold a third of the table. Each plan here first splits
the order axis into value buckets with a monotone expression, aggregates per
(group, bucket), accumulates over those few rows, and only then orders inside one
bucket after equal values have been collapsed. A bucket spans 1/128 of a power of
two, so it holds at most about 91 000 distinct 32-bit floats however many rows a
group has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 128


def value_bucket(value: Column, steps: int = STEPS_PER_OCTAVE) -> Column:
    """A monotone, signed bucket number; zero has a bucket of its own. ``steps`` buckets per power of two."""
    # The lift keeps log2 of the smallest positive double above zero, so signs never mix.
    size = F.floor(F.log2(F.abs(value).cast("double")) * steps) + 1100 * steps
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def _up_to_here(keys: Sequence[str], order: Sequence, peers: bool = True):
    window = Window.partitionBy(*keys).orderBy(*order)
    if peers:
        return window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def index_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Element ``min(n-1, floor(f*n))`` of each group's sorted values, one column per fraction.

    Two narrow passes: bucket totals locate the bucket of each quantile, then only
    rows of those buckets are collapsed by value. ``weight`` lets one row stand for
    many equal values.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    source = df.select(
        *keys, F.col(value).alias("_v"), w.cast("long").alias("_w"),
        value_bucket(F.col(value)).alias("_b"),
    )
    totals = source.groupBy(*keys, "_b").agg(F.sum("_w").alias("_nb"))
    targets = (
        totals.withColumn("_hi", F.sum("_nb").over(_up_to_here(keys, ["_b"])))
        .withColumn("n", F.sum("_nb").over(Window.partitionBy(*keys)))
        .withColumn(
            "_q",
            F.explode(F.array(*[
                F.struct(
                    F.lit(name).alias("name"),
                    F.least(F.col("n"), F.floor(F.lit(float(f)) * F.col("n")) + 1).alias("pos"),
                )
                for name, f in fractions.items()
            ])),
        )
        .where((F.col("_q.pos") > F.col("_hi") - F.col("_nb")) & (F.col("_q.pos") <= F.col("_hi")))
        .select(*keys, "_b", "n", F.col("_q.name").alias("_name"),
                (F.col("_q.pos") - F.col("_hi") + F.col("_nb")).alias("_pos"))
    )
    picked = (
        source.join(targets, [*keys, "_b"])
        .groupBy(*keys, "n", "_name", "_pos", "_v")
        .agg(F.sum("_w").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(_up_to_here([*keys, "_name"], ["_v"])))
        .where((F.col("_pos") > F.col("_cum") - F.col("_c")) & (F.col("_pos") <= F.col("_cum")))
    )
    return picked.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in fractions
    ])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    value: str | None = None,
    out: str = "pos",
) -> DataFrame:
    """0-based position in the order (value, row_id) within ``keys``; ``row_id`` is a unique long.

    Rows are counted per (bucket, value, row_id block of 65 536); the blocks' running
    totals are joined back, so the only per-row order is inside one block.
    """
    keys = list(keys)
    prefix = ["_b", "_v", "_blk"]
    v = F.col(value) if value else F.lit(0.0)
    rows = (
        df.withColumn("_v", v)
        .withColumn("_blk", F.shiftright(F.col(row_id).cast("long"), 16))
        .withColumn("_b", value_bucket(F.col("_v")) if value else F.shiftright(F.col("_blk"), 12))
    )
    blocks = rows.groupBy(*keys, *prefix).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_b").orderBy("_v", "_blk")
    blocks = blocks.withColumn(
        "_in", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    )
    buckets = blocks.groupBy(*keys, "_b").agg(F.sum("_n").alias("_nb"))
    buckets = buckets.withColumn(
        "_off", F.sum("_nb").over(_up_to_here(keys, ["_b"])) - F.col("_nb")
    ).drop("_nb")
    offsets = blocks.join(buckets, [*keys, "_b"]).select(
        *keys, *prefix, (F.col("_in") + F.col("_off")).alias("_start"))
    in_block = Window.partitionBy(*keys, *prefix).orderBy(row_id)
    return (
        rows.join(offsets, [*keys, *prefix])
        .withColumn(out, F.col("_start") + F.row_number().over(in_block) - 1)
        .drop(*prefix, "_start")
    )


def tie_ranks(ties: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average ranks within ``keys`` of ties(keys, _b, value, _c): a row per distinct value, its bucket and count."""
    keys = list(keys)
    per = ties.groupBy(*keys, "_b").agg(F.sum("_c").alias("_nb"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    upto = F.sum("_c").over(_up_to_here([*keys, "_b"], [value]))
    return ties.join(per, [*keys, "_b"]).withColumn(out, F.col("_off") + upto - (F.col("_c") - 1) / 2)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Ascending ranks within ``keys``; equal values share the mean of theirs. A group of any length is
    ordered by buckets, after equal values have collapsed."""
    keys = list(keys)
    ties = df.groupBy(*keys, value_bucket(F.col(value)).alias("_b"), value).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(tie_ranks(ties, keys, value, out).select(*keys, value, out), [*keys, value])


def descending_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1 + the number of strictly greater values within ``keys``; ties share a rank."""
    keys = list(keys)
    ties = df.groupBy(*keys, value_bucket(F.col(value)).alias("_b"), value).agg(F.count(F.lit(1)).alias("_c"))
    inside = _up_to_here([*keys, "_b"], [F.col(value).desc()])
    ties = ties.withColumn("_in", F.sum("_c").over(inside) - F.col("_c"))
    per = ties.groupBy(*keys, "_b").agg(F.sum("_c").alias("_nb"))
    per = per.withColumn("_off", F.sum("_nb").over(_up_to_here(keys, [F.col("_b").desc()])) - F.col("_nb"))
    place = ties.join(per.select(*keys, "_b", "_off"), [*keys, "_b"]).select(
        *keys, value, (F.col("_off") + F.col("_in") + 1).alias(out))
    return df.join(place, [*keys, value])


@dataclass(frozen=True)
class Candidate:
    """One correction of a step-up: ``at_rank(rank)`` is the candidate at a 1-based rank, a function of
    the strength, ``columns`` and the rank; each row gets the least of the candidates at its own and all
    weaker ranks, or the ``most``."""

    at_rank: Callable[[Column], Column]
    columns: tuple[str, ...] = ()
    most: bool = False


def step_up(df: DataFrame, keys: Sequence[str], strength: str, candidates: dict[str, Candidate]) -> DataFrame:
    """Benjamini-Hochberg style step-ups along descending ``strength`` within ``keys``, all in one pass.

    Rows are reduced to one per distinct strength, which stands for its tie group's largest rank; the
    rank's offset and the best candidate of weaker buckets are carried from bucket to bucket over a table
    of a row per bucket, so a group of any size is never ordered in one task and rows move twice however
    many corrections there are. Rows with a NULL strength stay NULL. ``df`` is read several times; an
    expensive one should be written before.
    """
    keys = list(keys)
    bucket = value_bucket(F.col(strength)).alias("_b")
    tested = df.where(F.col(strength).isNotNull())
    needed = dict.fromkeys(c for x in candidates.values() for c in x.columns if c not in keys and c != strength)
    ties = tested.groupBy(*keys, strength, bucket).agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in needed])
    per = tested.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_nb"))
    stronger = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select(*keys, "_b", F.coalesce(F.sum("_nb").over(stronger), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b")
    upto = inside.orderBy(F.col(strength).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ties.join(offset, [*keys, "_b"]).withColumn("_rank", F.col("_off") + F.sum("_c").over(upto))
    weaker = inside.orderBy(strength).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = {name: F.max if c.most else F.min for name, c in candidates.items()}
    fold = {name: F.greatest if c.most else F.least for name, c in candidates.items()}
    own = ranked.select(*keys, strength, "_b", *[pick[name](c.at_rank(F.col("_rank"))).over(weaker).alias(f"_own_{name}")
                                                 for name, c in candidates.items()])
    # The value at a bucket's strongest row is the bucket's best.
    best = own.groupBy(*keys, "_b").agg(*[pick[name](f"_own_{name}").alias(f"_best_{name}") for name in candidates])
    after = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = best.select(*keys, "_b", *[pick[name](f"_best_{name}").over(after).alias(f"_after_{name}") for name in candidates])
    solved = own.join(carried, [*keys, "_b"]).select(*keys, strength, *[
        fold[name](f"_own_{name}", F.coalesce(f"_after_{name}", f"_own_{name}")).alias(name) for name in candidates])
    return df.join(solved, [*keys, strength], "left")
