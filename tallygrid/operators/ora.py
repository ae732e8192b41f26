"""Over-representation: the hypergeometric upper tail for every (query, set) pair at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.special import ln_hypergeom_tail
from tallygrid.operators.ranktest import combined_score
from tallygrid.operators.setindex import SetIndex
from tallygrid.operators.sets import SIZE_MAX, SIZE_MIN
from tallygrid.plans.ordering import Candidate, step_up
from tallygrid.plans.session import cut_lineage

CUT = -math.log10(0.05)


def ora(
    query: DataFrame,
    members: DataFrame,
    background: DataFrame,
    sizes: tuple[int, int] = (SIZE_MIN, SIZE_MAX),
    sources: list[str] | None = None,
    by: list[str] | None = None,
    overlap: bool = False,
) -> DataFrame:
    """Sets over-represented in ``query`` (gene, optional pos) against the annotated background.

    Several queries of one library and background should share one ``SetIndex`` and ask
    ``ora_index``; this builds an index for the one call.
    """
    return ora_index(query, SetIndex.build(members, background), sizes, sources, by, overlap)


def ora_index(
    query: DataFrame,
    index: SetIndex,
    sizes: tuple[int, int] = (SIZE_MIN, SIZE_MAX),
    sources: list[str] | None = None,
    by: list[str] | None = None,
    overlap: bool = False,
) -> DataFrame:
    """Sets of ``index`` over-represented in ``query`` (gene, optional pos).

    ``by`` names query columns that tell several queries apart; all of them run in
    the same joins. The population is taken over every set of the index, before the size
    window and the source filter. BH counts the sets reported per query.
    """
    by = list(by or [])
    spelled = query.select(
        *by, F.upper("gene").alias("u"), "gene", (F.col("pos") if "pos" in query.columns else F.lit(0)).alias("pos"))
    asked = index.find(cut_lineage(spelled.groupBy(*by, "u").agg(F.min_by("gene", "pos").alias("gene"))))
    drawn = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("drawn"))
    hits = asked.select(*by, "gene", F.inline("sets")).where(F.col("set_size").between(*sizes))
    if sources is not None:
        hits = hits.where(F.col("source").isin(sources))
    rows = hits.groupBy(*by, "source", "set_id", "set_name", "set_size").agg(F.count(F.lit(1)).alias("overlap_size"))
    if by:
        rows = rows.join(drawn, by)
    else:
        rows = rows.withColumn("drawn", drawn.select("drawn").scalar())
    rows = rows.withColumn("population", index.population())
    ln_p = ln_hypergeom_tail(F.col("overlap_size"), F.col("set_size"), F.col("drawn"), F.col("population"))
    rows = (
        rows.withColumn("ln_p", ln_p)
        .withColumn("fold", (F.col("overlap_size") / F.col("drawn")) / (F.col("set_size") / F.col("population")))
        .withColumn("p", F.least(F.lit(1.0), F.coalesce(F.exp("ln_p"), F.lit(0.0))))
        .withColumn("nlp", F.greatest(F.lit(0.0), -F.col("ln_p") / math.log(10)))
        .drop("ln_p")
    )
    out = bh_both(cut_lineage(rows), by)
    if overlap:
        # At most sizes[1] names per set, so each list is bounded by the size window.
        names = hits.join(out.select(*by, "set_id"), [*by, "set_id"], "left_semi").groupBy(*by, "set_id").agg(
            F.array_sort(F.collect_list("gene")).alias("overlap"))
        out = out.join(names, [*by, "set_id"])
    return out


def bh_both(rows: DataFrame, by: list[str]) -> DataFrame:
    """``padj`` from p and ``nlp_adj`` from nlp; m is the number of rows of each query."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    if by:
        rows = rows.join(counts, by)
    else:
        rows = rows.withColumn("m", counts.select("m").scalar())

    rows = step_up(rows, by, "nlp", {
        "padj": Candidate(lambda rank: F.col("p") * F.col("m") / rank, ("p", "m")),
        "nlp_adj": Candidate(
            lambda rank: F.greatest(F.lit(0.0), F.col("nlp") - F.log10(F.col("m") / rank)), ("m",), most=True)})
    return rows.withColumn("padj", F.least(F.lit(1.0), "padj")).drop("m")


def top_terms(terms: DataFrame, n: int = 15, rank_by: str = "significance", by: list[str] | None = None) -> DataFrame:
    """The figure's terms: most significant first, or largest overlap first."""
    order = ([F.col("nlp_adj").desc(), F.col("fold").desc()] if rank_by == "significance"
             else [F.col("overlap_size").desc(), F.col("padj")])
    window = Window.partitionBy(*(by or [])).orderBy(*order, "set_id")
    if by:
        return terms.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)
    return terms.orderBy(*order, "set_id").limit(n)


def colour_domain(terms: DataFrame) -> DataFrame:
    """Ends of the colour scale: fitted below, never short of 1.2 times the 0.05 line above."""
    return terms.agg(
        F.coalesce(F.min("nlp_adj"), F.lit(0.0)).alias("lo"),
        F.greatest(F.lit(CUT * 1.2), F.coalesce(F.max("nlp_adj"), F.lit(0.0))).alias("hi"))


def term_detail(terms: DataFrame, members: DataFrame, de: DataFrame) -> DataFrame:
    """Overlap genes of each term with their test rows and combined score, in the test's own spelling."""
    mine = members.select("set_id", F.upper("gene").alias("u")).distinct().join(
        terms.select("set_id").distinct(), "set_id", "left_semi")
    return mine.join(de.withColumn("u", F.upper("gene")), "u").withColumn("combined", combined_score()).drop("u")
