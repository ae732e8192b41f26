"""The registry, shared SQL fragments and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.matrix import Matrix
from tallygrid.operators.nameindex import NameIndex
from tallygrid.operators.setindex import SetIndex
from tallygrid.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def retail(spark, sf) -> Matrix:
    return views.prepared(spark, sf, "retail")


def text(spark, sf) -> Matrix:
    return views.prepared(spark, sf, "text")


def vectors(spark, sf) -> Matrix:
    return views.prepared(spark, sf, "vectors")


_indexes: dict[tuple[str, str, str], SetIndex] = {}


def set_index(spark, sf, library: str, members: DataFrame, background: DataFrame) -> SetIndex:
    """The library's index over the background, written once per application as a user of several queries would."""
    key = (spark.sparkContext.applicationId, sf, library)
    if key not in _indexes:
        _indexes[key] = SetIndex.build(members, background)
    return _indexes[key]


_names: dict[tuple[str, str, str], NameIndex] = {}


def name_index(spark, sf, which: str, names: Callable[[], DataFrame], *searched) -> NameIndex:
    """The index of some names, written once per application."""
    key = (spark.sparkContext.applicationId, sf, which)
    if key not in _names:
        _names[key] = NameIndex.build(names(), list(searched))
    return _names[key]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round computed doubles and drop negative zeros, for comparison across engines."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


# ---- the three views in SQL ----

RETAIL = """WITH lab AS MATERIALIZED (
  SELECT c_custkey AS cell_id, c_mktsegment AS type, n_name AS sample, r_name AS cond, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
counts AS MATERIALIZED (
  SELECT p_brand || '/' || p_type AS gene, o_custkey AS cell_id, SUM(l_quantity) AS count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
tot AS (SELECT cell_id, SUM(count) AS total FROM counts GROUP BY 1),
expr AS MATERIALIZED (
  SELECT gene, cell_id, CAST(ln(1 + count * 1e4 / total) AS FLOAT) AS value FROM counts JOIN tot USING (cell_id)),
genes AS MATERIALIZED (SELECT p_brand || '/' || p_type AS gene, MIN(p_partkey) AS gene_id FROM part GROUP BY 1)"""

GEOMETRY = """, geo AS MATERIALIZED (
  SELECT c_custkey AS cell_id, CAST(c_acctbal AS FLOAT) AS x,
         CAST(COALESCE(round(spent, 2), 0.0) AS FLOAT) AS y
  FROM customer LEFT JOIN (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""

TEXT = r"""WITH words AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS gene FROM documents),
counts AS MATERIALIZED (
  SELECT gene, doc_id AS cell_id, CAST(COUNT(*) AS DOUBLE) AS count FROM words WHERE gene <> '' GROUP BY 1, 2),
expr AS MATERIALIZED (SELECT gene, cell_id, CAST(ln(1 + count) AS FLOAT) AS value FROM counts),
lab AS MATERIALIZED (SELECT doc_id AS cell_id, lang AS type, source AS sample, lang AS cond FROM documents),
genes AS MATERIALIZED (SELECT gene, MIN(cell_id) AS gene_id FROM counts GROUP BY 1)"""

VECTORS = """WITH expr AS MATERIALIZED (
  SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS gene, vec_id AS cell_id, CAST(unnest(embedding) AS FLOAT) AS value FROM embeddings),
lab AS MATERIALIZED (
  SELECT vec_id AS cell_id, CAST(label AS VARCHAR) AS type, CAST(label AS VARCHAR) AS sample,
         CAST(label AS VARCHAR) AS cond, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y FROM embeddings),
genes AS MATERIALIZED (SELECT gene, MIN(CAST(gene AS BIGINT)) AS gene_id FROM expr GROUP BY 1)"""

SETS = """, members AS MATERIALIZED (
  SELECT source, source_pos, set_id, gene, MIN(p_partkey) AS pos FROM (
    SELECT p_partkey, p_brand || '/' || p_type AS gene, 'brand' AS source, 0 AS source_pos,
           'BRAND_' || replace(p_brand, '#', '_') AS set_id FROM part
    UNION ALL SELECT p_partkey, p_brand || '/' || p_type, 'type', 1, 'TYPE_' || p_type FROM part
    UNION ALL SELECT p_partkey, p_brand || '/' || p_type, 'size', 2, 'SIZE_' || p_size FROM part)
  GROUP BY 1, 2, 3, 4)"""


# ---- formulas in SQL ----

def tail_sql(x: str) -> tuple[str, str]:
    """(ln tail, tail) of the standard normal at x >= 0: continued fraction from 2 on, series below."""
    frac = f"list_reduce(list_reverse(range(1, 81)), lambda f, k: k / ({x} + f), 0.0)"
    ln_far = f"(-({x}) * ({x}) / 2 - 0.5 * ln(2 * pi()) - ln(({x}) + {frac}))"
    series = (f"list_sum(list_transform(range(0, 61), lambda k: exp((2 * k + 1) * ln({x})"
              f" - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))))")
    near = f"(CASE WHEN {x} = 0 THEN 0.5 ELSE 0.5 - exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series} END)"
    return (f"(CASE WHEN {x} >= 2 THEN {ln_far} ELSE ln({near}) END)",
            f"(CASE WHEN {x} >= 2 THEN exp({ln_far}) ELSE {near} END)")


def rank_test_sql(prefix: str, labels: str, want: str = "TRUE", pct: float = 0.1, lfc: float = 0.25,
                  carry: bool = False, floor: int = 3, every: bool = False) -> str:
    """CTEs ending in ``de``: the dense definition of the rank-sum test with gates and corrections.
    ``every``: all measured genes take part, those without a value too."""
    base = ("SELECT gene, COALESCE(ad, 0) AS ad, COALESCE(total, 0.0) AS total FROM genes LEFT JOIN gs USING (gene)"
            if every else "SELECT * FROM gs")
    ln_tail, tail = tail_sql("abs(z)")
    keep = "TRUE" if carry else f"abs(lfc) >= {lfc}"
    return f"""{prefix},
lb AS MATERIALIZED ({labels}),
nn AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM genes) AS m FROM lb),
sz AS (SELECT grp, COUNT(*) AS n1 FROM lb GROUP BY 1),
nz AS MATERIALIZED (SELECT gene, grp, value FROM expr JOIN lb USING (cell_id) WHERE value <> 0),
pg AS (SELECT gene, grp, COUNT(*) AS d, SUM(exp(CAST(value AS DOUBLE)) - 1) AS s FROM nz GROUP BY 1, 2),
gs AS (SELECT gene, SUM(d) AS ad, SUM(s) AS total FROM pg GROUP BY 1),
g AS MATERIALIZED ({base}),
cand AS (
  SELECT g.gene, sz.grp, n1, n - n1 AS n2, COALESCE(d, 0) AS d, ad, n, m, COALESCE(s, 0.0) AS s, total
  FROM g CROSS JOIN sz CROSS JOIN nn LEFT JOIN pg ON pg.gene = g.gene AND pg.grp = sz.grp),
gated AS (
  SELECT *, CAST(d AS DOUBLE) / n1 AS pct1, CAST(ad - d AS DOUBLE) / n2 AS pct2,
         log2(s / n1 + 1) - log2((total - s) / n2 + 1) AS lfc
  FROM cand WHERE n1 >= {floor} AND n2 >= {floor} AND ({want})),
kept AS MATERIALIZED (SELECT *, abs(lfc) >= {lfc} AS tested FROM gated WHERE (pct1 >= {pct} OR pct2 >= {pct}) AND ({keep})),
tg AS MATERIALIZED (
  SELECT gene, value, COUNT(*) AS c FROM nz WHERE gene IN (SELECT gene FROM kept WHERE tested) GROUP BY 1, 2),
tr AS (SELECT gene, value, CAST(c AS DOUBLE) AS c, CAST(COALESCE(SUM(c) OVER (PARTITION BY gene ORDER BY value
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before FROM tg),
gt AS (SELECT gene, SUM(CAST(c AS DOUBLE) * c * c - c) AS t,
              CAST(SUM(CASE WHEN value < 0 THEN c ELSE 0 END) AS DOUBLE) AS neg FROM tg GROUP BY 1),
rs AS (
  SELECT nz.gene, nz.grp, SUM(before + (c + 1) / 2 + CASE WHEN value > 0 THEN n - ad ELSE 0 END) AS r
  FROM nz JOIN tr USING (gene, value) JOIN g USING (gene) CROSS JOIN nn GROUP BY 1, 2),
zz AS (
  SELECT k.*, COALESCE(r, 0.0) + (n1 - d) * (COALESCE(neg, 0.0) + (1 + (n - ad)) / 2.0) AS r1,
         COALESCE(t, 0.0) + CASE WHEN n - ad > 1 THEN CAST(n - ad AS DOUBLE) * (n - ad) * (n - ad) - (n - ad) ELSE 0 END AS ties
  FROM kept k LEFT JOIN rs ON rs.gene = k.gene AND rs.grp = k.grp LEFT JOIN gt ON gt.gene = k.gene),
zv AS (
  SELECT *, CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1))) AS var,
         abs(r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 - CAST(n1 AS DOUBLE) * n2 / 2) - 0.5 AS gap FROM zz),
zs AS (SELECT *, CASE WHEN var > 0 THEN gap / sqrt(var) END AS z FROM zv),
pv AS (
  SELECT gene, grp, n1, n2, pct1, pct2, lfc, m, tested,
         CASE WHEN NOT tested THEN NULL WHEN z IS NULL THEN 1.0 ELSE least(1.0, 2 * {tail}) END AS p,
         CASE WHEN NOT tested THEN NULL WHEN z IS NULL THEN 0.0
              ELSE greatest(0.0, -({ln_tail} + ln(2)) / ln(10)) END AS raw FROM zs),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp, tested ORDER BY raw DESC) AS rank FROM pv),
de AS MATERIALIZED (
  SELECT gene, grp, n1, n2, pct1, pct2, lfc, p, CASE WHEN tested THEN least(1.0, p * m) END AS padj,
         CASE WHEN tested THEN least(1.0, MIN(p * m / rank) OVER (PARTITION BY grp, tested ORDER BY rank
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS fdr,
         CASE WHEN tested THEN greatest(0.0, raw - log10(m)) END AS nlp FROM rk)"""


DE_COLUMNS = ("gene, grp, n1, n2, pct1, pct2, " + ", ".join(
    f"{r(c, d)} AS {c}" for c, d in (("lfc", 6), ("p", 9), ("padj", 9), ("fdr", 9), ("nlp", 6))))


def de_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "lfc", "nlp"), "p", "padj", "fdr", digits=9)


def lnchoose_sql(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


# Upper case with the German sharp s written out, as Unicode full case mapping has it.
UPPER = "upper(replace(gene, 'ß', 'ss'))"


def ora_sql(prefix: str, query: str, sizes: tuple[int, int], sources: str = "TRUE", by: str = "") -> str:
    """CTEs ending in ``ora``; ``query`` selects [by,] gene."""
    key = f"{by}, " if by else ""
    join_n = f"JOIN drawn USING ({by})" if by else "CROSS JOIN drawn"
    part = f"PARTITION BY {by} " if by else ""
    term = (f"{lnchoose_sql('set_size', 'i')} + {lnchoose_sql('population - set_size', 'drawn - i')}"
            f" - {lnchoose_sql('population', 'drawn')}")
    return f"""{prefix},
owner AS (SELECT set_id, MIN(source_pos) AS source_pos FROM members GROUP BY 1),
mine AS (SELECT DISTINCT source, set_id, {UPPER} AS u FROM members JOIN owner USING (set_id, source_pos)),
uni AS MATERIALIZED (SELECT DISTINCT {UPPER} AS u FROM genes WHERE {UPPER} IN (SELECT {UPPER} FROM members)),
inside AS MATERIALIZED (SELECT * FROM mine WHERE u IN (SELECT {UPPER} FROM genes)),
asked AS MATERIALIZED (SELECT DISTINCT {key}{UPPER} AS u FROM ({query}) WHERE {UPPER} IN (SELECT u FROM uni)),
drawn AS (SELECT {key}COUNT(*) AS drawn FROM asked {'GROUP BY ' + by if by else ''}),
ks AS (SELECT source, set_id, COUNT(*) AS set_size FROM inside GROUP BY 1, 2),
hit AS (SELECT {key}set_id, COUNT(*) AS overlap_size FROM inside JOIN asked USING (u) GROUP BY ALL),
trial AS MATERIALIZED (
  SELECT *, (SELECT COUNT(*) FROM uni) AS population FROM hit JOIN ks USING (set_id) {join_n}
  WHERE set_size BETWEEN {sizes[0]} AND {sizes[1]} AND ({sources})),
spread AS (SELECT *, unnest(range(overlap_size, least(set_size, drawn) + 1)) AS i FROM trial),
lt AS (SELECT {key}set_id, {term} AS t FROM spread WHERE drawn - i <= population - set_size),
mx AS (SELECT {key}set_id, MAX(t) AS top FROM lt GROUP BY ALL),
lp AS (SELECT {key}set_id, least(0.0, top + ln(SUM(exp(t - top)))) AS lnp FROM lt JOIN mx USING ({key}set_id) GROUP BY {key}set_id, top),
pq AS (SELECT *, (CAST(overlap_size AS DOUBLE) / drawn) / (CAST(set_size AS DOUBLE) / population) AS fold,
              least(1.0, exp(lnp)) AS p, greatest(0.0, -lnp / ln(10)) AS nlp FROM trial JOIN lp USING ({key}set_id)),
rq AS (SELECT *, row_number() OVER ({part}ORDER BY nlp DESC) AS rank, COUNT(*) OVER ({part}) AS m FROM pq),
ora AS MATERIALIZED (
  SELECT {key}source, set_id, set_size, drawn, population, overlap_size, fold, p, nlp,
         least(1.0, MIN(p * m / rank) OVER ({part}ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS padj,
         MAX(greatest(0.0, nlp - log10(CAST(m AS DOUBLE) / rank)))
           OVER ({part}ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nlp_adj FROM rq)"""


ORA_COLUMNS = "source, set_id, set_size, drawn, population, overlap_size, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("fold", "p", "nlp", "padj", "nlp_adj"))


def ora_rounded(df: DataFrame, *by: str) -> DataFrame:
    named = df.select(*by, "source", "set_id", "set_size", "drawn", "population", "overlap_size",
                      "fold", "p", "nlp", "padj", "nlp_adj")
    return rounded(named, "fold", "p", "nlp", "padj", "nlp_adj")
