"""Wilcoxon rank-sum tests over a sparse matrix: one-vs-rest markers and two-group contrasts.

Zeros are never visited. Values collapse to (gene, value, group) counts, ranks come
from running totals over value buckets, and the zeros enter as one tie block by
arithmetic. See ``plans.ordering`` for why no gene, however common, meets one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.special import two_sided
from tallygrid.operators.matrix import Matrix, scope, sides_overlap
from tallygrid.plans.ordering import Candidate, descending_rank, step_up, value_bucket
from tallygrid.plans.session import cut_lineage

# Fixed value: fewer cells than this on a side and nothing is tested.
MIN_CELLS_PER_SIDE = 3
# Buckets of a gene's values per power of two; each holds at most about 1.1 million distinct 32-bit floats.
BUCKETS_PER_OCTAVE = 8

COLUMNS = ["gene", "grp", "n1", "n2", "pct1", "pct2", "lfc", "p", "padj", "fdr", "nlp"]


@dataclass(frozen=True)
class Gates:
    """Detection rate and effect size a gene must reach to be tested.

    ``carry`` keeps a gene that is detected but below the effect gate as a row
    without a p-value.
    """

    pct: float = 0.1
    lfc: float = 0.25
    carry: bool = False


MARKER_GATES = Gates()
CONTRAST_GATES = Gates(0.1, 0.0, carry=True)
NO_GATES = Gates(0.0, 0.0, carry=True)


def markers(
    m: Matrix,
    group: str = "type",
    where: list[str] | str | None = None,
    want: list | None = None,
    gates: Gates = MARKER_GATES,
    min_cells: int = MIN_CELLS_PER_SIDE,
) -> DataFrame:
    """Every level of ``group`` against all other cells, in one pass.

    ``where`` limits the cells to some conditions. ``want`` limits which levels are
    reported, never what they are compared with. A level with fewer than ``min_cells``
    cells on either side is not tested. Genes without any value are not reported.
    """
    labels = scope(m.cells, conds=where).select("cell_id", F.col(group).alias("grp")).where("grp IS NOT NULL")
    return _test(m, labels, want, gates, min_cells, every_gene=False)


def wilcoxon(
    m: Matrix,
    types: list[str] | None,
    control: list[str] | str,
    compare: list[str] | str,
    gates: Gates = CONTRAST_GATES,
) -> DataFrame:
    """One side's conditions against another's within some types; ``grp`` is 'compare'.

    Without a detection gate every measured gene has a row; one without a value on
    either side has p = 1.
    """
    if sides_overlap(control, compare):
        raise ValueError("the two sides share a condition")
    other = F.when(F.col("cond").isin([control] if isinstance(control, str) else list(control)), "control")
    both = scope(m.cells, types).select(
        "cell_id",
        F.when(F.col("cond").isin([compare] if isinstance(compare, str) else list(compare)), "compare")
        .otherwise(other).alias("grp"),
    ).where("grp IS NOT NULL")
    gates = Gates(gates.pct, gates.lfc, carry=True)
    return _test(m, both, ["compare"], gates, MIN_CELLS_PER_SIDE, every_gene=gates.pct <= 0)


def _test(m: Matrix, labels: DataFrame, want: list | None, gates: Gates, min_cells: int, every_gene: bool) -> DataFrame:
    """One job from the matrix to p-values: label and reduce to (gene, value, group) counts, rank within
    buckets of a gene, carry over buckets, and gate. What the corrections read several times is written."""
    total = labels.agg(F.count(F.lit(1)).alias("v")).scalar()
    sizes = labels.groupBy("grp").agg(F.count(F.lit(1)).alias("n1")).withColumn("n2", total - F.col("n1"))
    report = sizes.where((F.col("n1") >= min_cells) & (F.col("n2") >= min_cells))
    if want is not None:
        report = report.where(F.col("grp").isin(list(want)) if want else F.lit(False))
    reduced = m.labelled(labels).groupBy("gene", "value", "grp").agg(F.count(F.lit(1)).alias("k"))
    genes = _rank_masses(reduced, total)
    if every_gene:
        # Genes without a value: nothing seen, everything in the block of zeros.
        none = F.array().cast(genes.schema["seen"].dataType)
        blank = {"all_d": F.lit(0), "all_s": F.lit(0.0), "ties": F.lit(0.0), "neg": F.lit(0), "seen": none}
        genes = m.genes.select("gene").join(genes, "gene", "left").select(
            "gene", *[F.coalesce(c, v).alias(c) for c, v in blank.items()])
    pairs = _gated(genes, sizes, report, total, gates)
    ranked = cut_lineage(_p_values(pairs, total))
    return adjust(ranked, ["grp"], m.genes.agg(F.count(F.lit(1)).alias("v")).scalar())


def _rank_masses(reduced: DataFrame, total: Column) -> DataFrame:
    """A row per gene with what its test needs: detected cells, sum of expm1, tie term and negative
    values of all groups, and the same with the rank mass of each group seen.

    Two passes over the order of a gene's values. The first works inside a bucket: equal values of a group
    have collapsed, ranks are running totals, and groups are folded once the ranks are known. What is left
    of a bucket is its carry, a row per group. The second runs over the carries of a gene and adds what
    stands before each bucket.
    """
    k, c = F.col("k"), F.col("c").cast("double")
    bucket = value_bucket(F.col("value"), BUCKETS_PER_OCTAVE).alias("b")
    inside = Window.partitionBy("gene", "b")
    upto = inside.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    values = reduced.select("gene", bucket, "value", "grp", "k").withColumns({
        "upto": F.sum("k").over(upto), "c": F.sum("k").over(Window.partitionBy("gene", "b", "value"))})
    carries = (
        values
        .groupBy("gene", "b", "grp").agg(
            F.sum("k").alias("k"), F.sum(k * F.expm1(F.col("value").cast("double"))).alias("s"),
            F.sum(k * (F.col("upto") - (c - 1) / 2)).alias("mass"), F.sum(k * (c * c - 1)).alias("tie"))
    )
    upto = Window.partitionBy("gene").orderBy("b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.sum("k").over(Window.partitionBy("gene", "b"))
    whole = Window.partitionBy("gene")
    carries = (
        carries.withColumn("all_d", F.sum("k").over(whole))
        .withColumn("start", F.sum("k").over(upto) - block + F.when(F.col("b") > 0, total - F.col("all_d")).otherwise(0))
    )
    per = carries.groupBy("gene", "grp").agg(
        F.sum("k").alias("d"), F.sum("s").alias("s"), F.sum(F.col("mass") + k * F.col("start")).alias("r"),
        F.sum("tie").alias("tie"), F.sum(F.when(F.col("b") < 0, k).otherwise(0)).alias("neg"))
    # A gene's list has one entry per group, as the full grid of the result may have.
    return per.groupBy("gene").agg(
        F.sum("d").alias("all_d"), F.sum("s").alias("all_s"), F.sum("tie").alias("ties"), F.sum("neg").alias("neg"),
        F.collect_list(F.struct("grp", "d", "s", "r")).alias("seen"))


def _gated(genes: DataFrame, sizes: DataFrame, report: DataFrame, total: Column, gates: Gates) -> DataFrame:
    """(gene, grp) pairs that pass, absent pairs of common genes included."""
    # A group without the gene can pass only if the other side is detected often enough.
    need = gates.pct * (total - sizes.agg(F.max("n1").alias("v")).scalar())
    levels = report.agg(F.collect_list("grp").alias("v")).scalar()
    absent = F.transform(
        F.array_except("levels", F.col("seen.grp")),
        lambda g: F.struct(g.alias("grp"), F.lit(0).cast("long").alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("r")))
    full = F.when(F.col("all_d") >= need, F.concat("seen", absent)).otherwise(F.col("seen"))
    d, s = F.col("d"), F.col("s")
    return (
        genes.withColumn("levels", levels).select("gene", "all_d", "all_s", "ties", "neg", F.inline(full))
        .join(report, "grp")
        .withColumn("pct1", d / F.col("n1"))
        .withColumn("pct2", (F.col("all_d") - d) / F.col("n2"))
        .where((F.col("pct1") >= gates.pct) | (F.col("pct2") >= gates.pct))
        .withColumn("lfc", F.log2(s / F.col("n1") + 1) - F.log2((F.col("all_s") - s) / F.col("n2") + 1))
        .where(~F.isnan("lfc") & (F.abs("lfc") < float("inf")))
        .withColumn("tested", F.abs("lfc") >= gates.lfc)
        .where(F.lit(True) if gates.carry else F.col("tested"))
    )


def _p_values(pairs: DataFrame, total: Column) -> DataFrame:
    """z, p and nlp for each pair that is to be tested; the zero block enters by arithmetic."""
    z0 = (total - F.col("all_d")).cast("double")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    rank = F.col("r") + (n1 - F.col("d")) * (F.col("neg") + (z0 + 1) / 2)
    tie_sum = F.col("ties") + F.when(z0 > 1, z0 * z0 * z0 - z0).otherwise(0.0)
    mean = n1 * n2 / 2
    spread = n1 * n2 / 12 * (n + 1 - tie_sum / (n * (n - 1)))
    gap = F.abs(rank - n1 * (n1 + 1) / 2 - mean) - 0.5
    flat = (F.col("spread") <= 0) | (F.col("all_d") == 0)
    per = pairs.withColumn("spread", spread).withColumn(
        "z", F.when(F.col("tested") & ~flat, gap / F.sqrt("spread")))
    # Nothing varies: tested, and nothing found.
    return two_sided(per, "z").select(
        "gene", "grp", "n1", "n2", "pct1", "pct2", "lfc",
        F.when(F.col("tested"), F.coalesce("p", F.lit(1.0))).alias("p"),
        F.when(F.col("tested"), F.coalesce("nlp", F.lit(0.0))).alias("nlp"))


def adjust(df: DataFrame, by: list[str], n_features: Column | int) -> DataFrame:
    """Bonferroni ``padj``, Benjamini-Hochberg ``fdr`` and the adjusted ``nlp``.

    Both corrections count every feature measured; BH ranks run over tested rows only,
    along the raw nlp, and before nlp is clamped.
    """
    n_features = n_features if isinstance(n_features, Column) else F.lit(n_features)
    m = F.greatest(n_features, F.lit(1)).cast("double")

    out = step_up(df, by, "nlp", {"_q": Candidate(lambda rank: F.col("p") * m / rank, ("p",))})
    return out.withColumns({
        "fdr": F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("_q"))),
        "padj": F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("p") * m)),
        "nlp": F.when(F.col("p").isNotNull(), F.greatest(F.lit(0.0), F.col("nlp") - F.log10(m))),
    }).select(*[c for c in COLUMNS if c in {*out.columns, "fdr", "padj", "nlp"}],
              *[c for c in by if c not in COLUMNS])


# ---- reading the rows ----

def significant(threshold: float = 0.05, lfc: float = 0.25, basis: str = "padj") -> Column:
    """Strictly under the threshold and at least the effect size; untested rows are not."""
    return F.coalesce((F.col(basis) < threshold) & (F.abs("lfc") >= lfc), F.lit(False))


def combined_score() -> Column:
    """Signed metric nlp * lfc; NULL for an untested row."""
    return F.col("nlp") * F.col("lfc")


def display_order(by: list[str] | None = None) -> list[Column]:
    return [*(F.col(c) for c in by or []), F.col("nlp").desc_nulls_last(), F.abs("lfc").desc(), F.col("gene")]


def top_markers(de: DataFrame, n: int = 5, threshold: float = 0.05, lfc: float = 0.25) -> DataFrame:
    """First ``n`` significant, raised genes of each group.

    Spark limits ``row_number() <= n`` per partition before the shuffle, so a group
    with very many rows costs n rows per task.
    """
    order = Window.partitionBy("grp").orderBy(F.col("nlp").desc(), F.abs("lfc").desc(), "gene")
    return de.where(significant(threshold, lfc) & (F.col("lfc") > 0)).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= n)


def combined_rank(de: DataFrame) -> DataFrame:
    """Tested rows with their place by |combined score| within each group; equal scores share a place."""
    scored = de.withColumn("combined", combined_score()).where("combined IS NOT NULL")
    return descending_rank(scored.withColumn("_size", F.abs("combined")), ["grp"], "_size", "place").drop("_size")


def table_view(de: DataFrame, search: str = "", only_significant: bool = False) -> DataFrame:
    """Rows whose gene contains the words typed, case aside; optionally only significant ones."""
    out = de.where(F.upper("gene").contains(search.upper())) if search else de
    return out.where(significant()) if only_significant else out


def up_down(de: DataFrame, threshold: float = 0.05, lfc: float = 0.25) -> DataFrame:
    sig = significant(threshold, lfc)
    return de.groupBy("grp").agg(
        F.count_if(sig & (F.col("lfc") > 0)).alias("up"), F.count_if(sig & (F.col("lfc") < 0)).alias("down"),
        F.count("p").alias("tested"), F.count(F.lit(1)).alias("seen"))


def volcano_extent(de: DataFrame) -> DataFrame:
    """Axis ranges of the volcano: at least 3 and 6, with a margin."""
    points = de.where("p IS NOT NULL")
    return points.groupBy("grp").agg(
        (F.greatest(F.lit(3.0), F.max(F.abs("lfc"))) * 1.12).alias("x"),
        (F.greatest(F.lit(6.0), F.max("nlp")) * 1.08).alias("y"),
        F.count(F.lit(1)).alias("points"))
