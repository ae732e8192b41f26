"""Correlation of every gene with a seed over an axis, in time proportional to the non-zeros."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.axes import Axis
from tallygrid.operators.matrix import Matrix
from tallygrid.operators.score import block_moments, block_scores, weight_blocks
from tallygrid.plans.ordering import average_ranks, tie_ranks, value_bucket
from tallygrid.plans.pairs import pair_sums
from tallygrid.plans.session import cut_lineage

FLAT = 1e-12
DETECTION_FLOOR = 0.1
POWER_STEPS = 50
#: Loads that move by less have settled.
SETTLED = 1e-10


def profiles(m: Matrix, axis: Axis, genes: DataFrame | None = None) -> DataFrame:
    """gene, bucket, mean, hit over the buckets a gene is seen in (elsewhere its mean is 0)."""
    expr = m.nonzero() if genes is None else m.nonzero().join(genes.select("gene").distinct(), "gene", "left_semi")
    placed = expr.join(axis.assign, "cell_id")
    if not axis.pooled:
        return placed.select("gene", "bucket", F.col("value").cast("double").alias("mean"), F.lit(1).cast("long").alias("hit"))
    sums = placed.groupBy("gene", "bucket").agg(
        F.sum(F.col("value").cast("double")).alias("s"), F.count(F.lit(1)).alias("hit"))
    return sums.join(axis.sizes, "bucket").select("gene", "bucket", (F.col("s") / F.col("n")).alias("mean"), "hit")


def buckets_of(axis: Axis) -> DataFrame:
    return axis.sizes.select("bucket") if axis.pooled else axis.assign.select("bucket")


def seed_profile(m: Matrix, axis: Axis, gene: str) -> DataFrame:
    """bucket, s for one gene, zeros filled in."""
    own = profiles(m, axis, m.genes.where(F.col("gene") == gene)).select("bucket", F.col("mean").alias("s"))
    return buckets_of(axis).join(own, "bucket", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def standardise(profile: DataFrame, value: str = "s") -> DataFrame:
    """Centred and scaled to unit norm; empty when the profile does not vary."""
    stat = profile.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n")).first()
    if stat["sd"] is None or not stat["sd"] > FLAT:
        return profile.limit(0)
    scale = 1.0 / (stat["sd"] * stat["n"] ** 0.5)
    return profile.withColumn(value, (F.col(value) - stat["mean"]) * scale)


def _seed_ranks(seed: DataFrame, n: int) -> tuple[DataFrame, float, float]:
    """Average ranks of a seed over ``n`` buckets: (bucket, s) where it is not zero, the rank of its
    zeros, and the sum of squares of all ranks."""
    some = cut_lineage(average_ranks(seed.where("s <> 0"), [], "s").select("bucket", "s", "rank"))
    count = some.agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("s") < 0).alias("neg")).first()
    absent = n - count["present"]
    level = count["neg"] + (absent + 1) / 2
    ranks = some.select("bucket", (F.col("rank") + F.when(F.col("s") > 0, absent).otherwise(0)).alias("s"))
    square = ranks.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return ranks, level, square + absent * level * level


def _rank_sums(values: DataFrame, seed: DataFrame, level: float, n: int) -> DataFrame:
    """gene, hit and the sums of ranks that a correlation needs, for values(gene, bucket, mean, hit) over ``n`` buckets.

    A profile may be as long as the table has cells: equal values collapse to one row with their
    count and the sum of the seed's ranks, these rows are ranked by value buckets, and the buckets
    without a value enter as one tie block by arithmetic.
    """
    own = F.coalesce("s", F.lit(level))
    seen = F.col("mean") != 0
    ties = values.join(seed, "bucket", "left").groupBy("gene", value_bucket(F.col("mean")).alias("_b"), "mean").agg(
        F.count_if(seen).alias("_c"), F.sum(F.when(seen, own).otherwise(0.0)).alias("own"), F.sum("hit").alias("hit"))
    c, rank, up = F.col("_c"), F.col("rank"), F.col("mean") > 0
    only_up = lambda x: F.sum(F.when(up, x).otherwise(0))
    sums = tie_ranks(ties, ["gene"], "mean").groupBy("gene").agg(
        F.sum("hit").alias("hit"), F.sum("_c").alias("present"), F.sum(F.when(F.col("mean") < 0, c).otherwise(0)).alias("neg"),
        F.sum("own").alias("own"), F.sum(c * rank * rank).alias("square"), F.sum(F.col("own") * rank).alias("product"),
        only_up(c).alias("up"), only_up(c * rank).alias("up_rank"), only_up(F.col("own")).alias("up_own"))
    absent = n - F.col("present")
    zero = F.col("neg") + (absent + 1) / 2
    return sums.select(
        "gene", "hit", F.lit(n * (n + 1) / 2).alias("g"),
        (F.col("square") + 2 * absent * F.col("up_rank") + absent * absent * F.col("up") + absent * zero * zero).alias("q"),
        (F.col("product") + absent * F.col("up_own") + zero * (n * (n + 1) / 2 - F.col("own"))).alias("sg"))


def correlate(m: Matrix, axis: Axis, seed: DataFrame, method: str = "pearson",
              min_pct: float = DETECTION_FLOOR) -> DataFrame:
    """gene, r, pct for every gene detected in at least ``min_pct`` of the cells; r is NULL if flat.

    Zero buckets add nothing to the sums, so only non-zeros are aggregated. On a
    pooled axis the seed is one short table; per cell it is joined on the cell.
    Spearman takes average ranks over an axis of any length.
    """
    # Cells that landed in a bucket, as one number.
    cells = (axis.sizes.agg(F.sum("n").alias("v")) if axis.pooled
             else axis.assign.agg(F.count(F.lit(1)).alias("v"))).first()["v"] or 0
    prof = profiles(m, axis)
    tot = seed.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")).first()
    n, s_sum, s_sq = tot["n"], tot["s"] or 0.0, tot["q"] or 0.0
    if method == "spearman":
        ranks, level, s_sq = _seed_ranks(seed, n)
        s_sum = n * (n + 1) / 2
        sums = _rank_sums(prof, ranks, level, n)
    else:
        x = F.col("mean")
        sums = prof.join(seed, "bucket").groupBy("gene").agg(
            F.sum("hit").alias("hit"), F.sum(x).alias("g"), F.sum(x * x).alias("q"), F.sum(F.col("s") * x).alias("sg"))
    return _r(sums, n, s_sum, s_sq, F.col("hit") / F.lit(float(max(cells, 1))), F.col("hit") >= min_pct * cells)


def _r(sums: DataFrame, n: int, s_sum: float, s_sq: float, pct: Column, ranked: Column) -> DataFrame:
    g_var = n * F.col("q") - F.col("g") * F.col("g")
    s_var = n * s_sq - s_sum * s_sum
    r = (n * F.col("sg") - s_sum * F.col("g")) / F.sqrt(g_var * s_var)
    varies = (g_var > FLAT) & F.lit(s_var > FLAT)
    return sums.where(ranked).select("gene", F.when(varies, r).alias("r"), pct.alias("pct"))


def corr_top(rows: DataFrame, n: int, members: list[str] = (), hide_members: bool = False) -> DataFrame:
    """Both ends: the ``n`` highest and the ``n`` lowest r, a seed's own members flagged."""
    rows = rows.where("r IS NOT NULL").withColumn("member", F.col("gene").isin(list(members)) if members else F.lit(False))
    if hide_members:
        rows = rows.where(~F.col("member"))
    up = rows.orderBy(F.col("r").desc(), "gene").limit(n).withColumn("end", F.lit("up"))
    down = rows.orderBy(F.col("r"), F.col("gene").desc()).limit(n).withColumn("end", F.lit("down"))
    return up.unionByName(down)


# ---- pseudobulk axis ----


def pseudobulk_values(pb: DataFrame, cells: DataFrame, clusters: list | None = None,
                      conds: list | None = None) -> tuple[DataFrame, int]:
    """log1p of counts per ten thousand per column: gene, bucket, mean, hit; and the number of columns.

    The table, a row per gene and column, is written first: its columns, totals and values are all
    read off it, and the matrix behind it is summed once."""
    pb = cut_lineage(pb)
    columns = pb.select("sample", "type").distinct()
    if clusters is not None:
        columns = columns.where(F.col("type").isin(clusters))
    if conds is not None:
        of = cells.groupBy("sample").agg(F.min_by("cond", "cell_id").alias("cond"))
        columns = columns.join(of.where(F.col("cond").isin(conds)), "sample", "left_semi")
    n = columns.count()
    kept = columns.withColumn("bucket", F.row_number().over(Window.orderBy("sample", "type")) - 1)
    inside = pb.join(kept, ["sample", "type"])
    total = inside.groupBy("bucket").agg(F.sum("count").alias("total"))
    norm = F.log1p(F.col("count") / F.when(F.col("total") == 0, 1).otherwise(F.col("total")) * 1e4)
    values = inside.join(total, "bucket").select(
        "gene", "bucket", norm.alias("mean"), (F.col("count") > 0).cast("long").alias("hit"))
    return values, n


def correlate_dense(values: DataFrame, n_columns: int, seed: DataFrame, min_pct: float = DETECTION_FLOOR,
                    method: str = "pearson") -> DataFrame:
    """Pearson or Spearman over pseudobulk columns; fewer than three columns give no result."""
    if n_columns < 3:
        return values.select("gene", F.lit(None).cast("double").alias("r"), F.lit(0.0).alias("pct")).limit(0)
    share = F.col("hit") / F.lit(float(n_columns))
    if method == "spearman":
        ranks, level, square = _seed_ranks(seed, n_columns)
        sums = _rank_sums(values, ranks, level, n_columns)
        return _r(sums, n_columns, n_columns * (n_columns + 1) / 2, square, share, share >= min_pct)
    tot = seed.agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")).first()
    x = F.col("mean")
    sums = values.join(seed, "bucket", "left").groupBy("gene").agg(
        F.sum("hit").alias("hit"), F.sum(x).alias("g"), F.sum(x * x).alias("q"),
        F.sum(F.coalesce("s", F.lit(0.0)) * x).alias("sg"))
    return _r(sums, n_columns, tot["s"] or 0.0, tot["q"] or 0.0, share, share >= min_pct)


# ---- sets as seeds ----


def _set_profiles(m: Matrix, axis: Axis, sets: DataFrame) -> tuple[DataFrame, Column]:
    prof = profiles(m, axis, sets).join(sets.select("set_id", "gene").distinct(), "gene")
    return prof.select("set_id", "gene", "bucket", "mean"), axis.sizes.agg(F.count(F.lit(1)).alias("v")).scalar()


def within_set(m: Matrix, axis: Axis, sets: DataFrame) -> DataFrame:
    """Member-by-member correlations of each set: set_id, gene_a <= gene_b, r; members that do not vary
    are left out. The pairs are the result."""
    prof, n = _set_profiles(m, axis, sets)
    pairs = pair_sums(prof.select(F.col("set_id").alias("grp"), F.col("gene").alias("row"),
                                  F.col("bucket").alias("col"), F.col("mean").alias("value")), n)
    varied = F.least("norm_a", "norm_b") > FLAT * F.sqrt("n")
    return pairs.where(varied).select(
        F.col("grp").alias("set_id"), F.col("row_a").alias("gene_a"), F.col("row_b").alias("gene_b"),
        (F.col("cov") / (F.col("norm_a") * F.col("norm_b"))).alias("r"))


def set_coherence(m: Matrix, axis: Axis, sets: DataFrame) -> DataFrame:
    """Each set's leading direction: per member its sign and weight, per set coherence, flipped, mean_r.

    Power steps for all sets at once, without any member-by-member matrix: a step adds up the
    members' loads times their unit-norm profiles per set and pool, then these sums times the
    profiles per set and member. Profiles are sparse; what a member's empty pools add is the same
    for all of them, its baseline, and enters by arithmetic. The steps end when no load moves any
    more. No group is gathered, so a set may hold any share of the genes.
    """
    prof, _ = _set_profiles(m, axis, sets)
    prof = cut_lineage(prof)
    n = axis.sizes.count()
    stat = prof.groupBy("set_id", "gene").agg(F.sum("mean").alias("s"), F.sum(F.col("mean") * F.col("mean")).alias("q"))
    mu = F.col("s") / n
    stat = stat.withColumn("norm", F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * mu))).where(
        F.col("norm") > FLAT * n ** 0.5).select("set_id", "gene", "norm", (mu / F.col("norm")).alias("mu"))
    stat = cut_lineage(stat)
    rows = cut_lineage(prof.join(stat, ["set_id", "gene"]).select("set_id", "gene", "bucket", (F.col("mean") / F.col("norm")).alias("x")))
    size = stat.groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    loads = stat.join(size, "set_id").select(
        "set_id", "gene", "mu", "k", (1 / F.sqrt("k")).alias("load"), F.lit(0.0).alias("top"))
    for _ in range(POWER_STEPS):
        step = rows.join(_pool_sums(rows, loads), ["set_id", "bucket"]).groupBy("set_id", "gene").agg(
            F.sum(F.col("x") * F.col("y")).alias("v"))
        length = step.groupBy("set_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
        goes = F.col("length") > FLAT
        loads = cut_lineage(loads.drop("before").join(step, ["set_id", "gene"]).join(length, "set_id").select(
            "set_id", "gene", "mu", "k", F.when(goes, F.col("v") / F.col("length")).otherwise(F.col("load")).alias("load"),
            F.when(goes, F.col("length")).otherwise(F.col("top")).alias("top"), F.col("load").alias("before")))
        moved = loads.agg(F.max(F.abs(F.col("load") - F.col("before")))).first()[0]
        if moved is None or moved <= SETTLED:
            break
    # The largest load is positive; of loads that are equal but for rounding, that of the first gene.
    lead = loads.groupBy("set_id").agg(F.min_by("load", F.struct(-F.round(F.abs("load"), 9), "gene")).alias("lead"))
    signed = cut_lineage(loads.join(lead, "set_id").withColumn("load", F.when(F.col("lead") < 0, -F.col("load")).otherwise(F.col("load"))))
    sign = F.when(F.col("load") < 0, -1).otherwise(1)
    pools = _pool_sums(rows, signed.select("set_id", "gene", "mu", sign.cast("double").alias("load")))
    base = signed.groupBy("set_id").agg(F.sum(sign * F.col("mu")).alias("c"))
    square = pools.groupBy("set_id").agg(F.sum(F.col("y") * F.col("y")).alias("square"), F.count(F.lit(1)).alias("pools"))
    whole = signed.groupBy("set_id", "k", "top").agg(F.count_if(F.col("load") < 0).cast("int").alias("flipped")).join(
        square, "set_id").join(base, "set_id")
    off = (F.col("square") + (n - F.col("pools")) * F.col("c") * F.col("c") - F.col("k")) / 2
    one = F.col("k") == 1
    whole = whole.select(
        "set_id", F.when(one, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top") / F.col("k")))).alias("coherence"),
        "flipped", F.when(one, 1.0).otherwise(off / F.try_divide(F.col("k") * (F.col("k") - 1), F.lit(2))).alias("mean_r"))
    return signed.select("set_id", "gene", sign.alias("sign"), F.abs("load").alias("weight")).join(whole, "set_id")


def _pool_sums(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """(set_id, bucket, y): the members' profiles times their loads, for the pools that any member is seen in."""
    base = loads.groupBy("set_id").agg(F.sum(F.col("load") * F.col("mu")).alias("c"))
    sums = rows.join(loads.select("set_id", "gene", "load"), ["set_id", "gene"]).groupBy("set_id", "bucket").agg(
        F.sum(F.col("load") * F.col("x")).alias("a"))
    return sums.join(base, "set_id").select("set_id", "bucket", (F.col("a") - F.col("c")).alias("y"))


def composite(m: Matrix, axis: Axis, shape: DataFrame) -> DataFrame:
    """Sets' combined seeds over any axis: set_id, bucket, s; without set_id for a shape that has none.

    ``shape`` is (set_id, gene, sign, weight). Every member counts as its signed,
    weighted unit-norm profile; a bucket without the member stands at that profile's
    baseline, so only non-zeros are summed. A set whose seed does not vary has no rows. For the
    per-cell axis the signs come from a pooled one, see ``set_coherence``; there the sums are as many
    as the result and are formed cell by cell.
    """
    named = "set_id" in shape.columns
    weights = shape.select(F.col("set_id") if named else F.lit("").alias("set_id"), "gene", (F.col("sign") * F.col("weight")).alias("w"))
    n = buckets_of(axis).count()
    prof = profiles(m, axis, weights)
    stat = prof.groupBy("gene").agg(F.sum("mean").alias("s"), F.sum(F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / n
    var = F.col("q") / n - mean * mean
    scaled = stat.withColumn("var", var).where(F.col("var") > FLAT * FLAT).join(weights, "gene").select(
        "set_id", "gene", mean.alias("mu"), (F.col("w") / F.sqrt(F.col("var") * n)).alias("scale"))
    scaled = cut_lineage(scaled)
    if not axis.pooled:
        out = _cell_seeds(buckets_of(axis), prof, scaled, n)
        return out if named else out.drop("set_id")
    base = scaled.groupBy("set_id").agg(F.sum(-F.col("mu") * F.col("scale")).alias("base"))
    sums = cut_lineage(prof.join(scaled.select("set_id", "gene", "scale"), "gene").groupBy("set_id", "bucket").agg(
        F.sum(F.col("mean") * F.col("scale")).alias("s")))
    # Moments over all buckets; those without any member stand at the base.
    value = F.col("s") + F.col("base")
    moments = sums.join(base, "set_id").groupBy("set_id", "base").agg(
        F.sum(value).alias("t"), F.sum(value * value).alias("q"), F.count(F.lit(1)).alias("seen"))
    rest = n - F.col("seen")
    mean = (F.col("t") + rest * F.col("base")) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") + rest * F.col("base") * F.col("base")) / n - mean * mean))
    facts = moments.select("set_id", "base", mean.alias("mean"), spread.alias("sd")).where(F.col("sd") > FLAT)
    # Every bucket of every set is the result; the list has one entry per set.
    listed = facts.agg(F.collect_list(F.struct("set_id", "base", "mean", "sd")).alias("v")).scalar()
    full = buckets_of(axis).withColumn("facts", listed).select("bucket", F.inline("facts")).join(sums, ["set_id", "bucket"], "left")
    out = full.select("set_id", "bucket", (
        (F.coalesce("s", F.lit(0.0)) + F.col("base") - F.col("mean")) / (F.col("sd") * n ** 0.5)).alias("s"))
    return out if named else out.drop("set_id")


def _cell_seeds(buckets: DataFrame, prof: DataFrame, scaled: DataFrame, n: int) -> DataFrame:
    """set_id, bucket, s over cells. A cell is written once as a row and meets the scaled members in a task,
    as in ``score_many``: first for the moments of each set over all cells, then for the result. No product
    of a value with a set leaves its task, so what is shuffled grows with the non-zeros, however many sets hold a gene."""
    rows = cut_lineage(buckets.join(
        prof.groupBy("bucket").agg(F.collect_list(F.struct("gene", F.col("mean").alias("value"))).alias("row")),
        "bucket", "left").withColumnRenamed("bucket", "cell_id"))
    sets = cut_lineage(scaled.groupBy("set_id").agg(F.sum(-F.col("mu") * F.col("scale")).alias("base")))
    bases = {row["set_id"]: row["base"] for row in sets.select("set_id", "base").toLocalIterator()}
    weights = scaled.select("set_id", F.col("gene").cast("string").alias("gene"), F.col("scale").alias("weight"))
    parts = []
    for block in weight_blocks(sets.select("set_id"), weights):
        ids = block.sets.to_pylist()
        base = np.array([bases[s] for s in ids])
        sums = {row["set_id"]: (row["t"], row["q"]) for row in block_moments(rows, block, base).collect()}
        t, q = np.array([sums[s] for s in ids]).reshape(-1, 2).T
        spread = np.sqrt(np.maximum(0.0, q / n - (t / n) ** 2))
        varies = spread > FLAT
        scale = 1 / (spread[varies] * n ** 0.5)
        parts.append(block_scores(rows, block.scaled(varies, scale), (base - t / n)[varies] * scale))
    return reduce(DataFrame.union, parts).withColumnsRenamed({"cell_id": "bucket", "score": "s"})
